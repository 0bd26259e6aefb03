"""The queries of this package as DuckDB SQL, each written on its own."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# CRC-32 byte by byte with the table of the polynomial 0xEDB88320, which is 3988292384.
SHARDING = """
WITH RECURSIVE bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1
  FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8
), bytes AS (
  SELECT doc_id, source, text, hex(encode(coalesce(text, ''))) AS h FROM documents
), hashed AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(range(length(h) // 2),
                            lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
         CAST('0x' || substr(md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)
              AS BIGINT) AS k
  FROM bytes, tab
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS r,
         count(*) OVER (PARTITION BY source) AS n,
         count(*) OVER () AS total
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (
           ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE),
                    source NULLS FIRST, k, doc_id) - 1 AS g
  FROM ranked
), cut AS (SELECT *, g * 24 // total AS s FROM placed)
SELECT doc_id, CAST(strlen(body) + 8 AS BIGINT) AS size,
       text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY s ORDER BY g) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(raw, {_BLANKS}), {_LOWER}) AS k FROM line
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, raw, pos, (keeper IS NOT NULL AND doc_id <> keeper) AS lost
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         list_filter(string_split(coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), ''), '&'),
                     lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))
           AS query
  FROM pages
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(query) = 0 THEN '' ELSE '?' || array_to_string(query, '&') END
            AS canonical
  FROM parts
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM named, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
), listing AS (
  SELECT DISTINCT canonical FROM named
  WHERE starts_with(md5('listing:' || canonical), '7')
)
SELECT n.page_id, n.host, n.path, f.rule,
       CASE WHEN f.v IS NOT NULL THEN f.v WHEN l.canonical IS NOT NULL THEN 'block'
            ELSE 'allow' END AS verdict
FROM named n LEFT JOIN fit f USING (page_id) LEFT JOIN listing l ON n.canonical = l.canonical
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') AS ws
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORDS}') AS ws
  FROM benchmark
), item_at AS (
  SELECT item, ws, least(len(ws), 10) AS span,
         unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i
  FROM item WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item, span, array_to_string(ws[i : i + span - 1], ' ') AS w FROM item_at
), doc_at AS (
  SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i
  FROM doc, (SELECT DISTINCT span FROM windows) WHERE len(ws) >= span
), found AS (
  SELECT d.doc_id, d.i, d.span, w.item
  FROM doc_at d JOIN windows w
    ON w.span = d.span AND w.w = array_to_string(d.ws[d.i : d.i + d.span - 1], ' ')
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM found) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
         sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# The CRC-32 of a decimal number, digit by digit with the table of the polynomial 3988292384.
PREFIX_TRIE = """
WITH RECURSIVE bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1
  FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8
), turns AS (
  SELECT conv_id AS c,
         list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), numbered AS (
  SELECT c, ts, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(CAST(c AS VARCHAR), ''),
                            lambda d: CAST(ascii(d) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM turns, tab
), rebuilt AS (
  SELECT n.c, CASE WHEN n.c % 100 = 0 THEN n.ts
              ELSE list_concat(coalesce(b.ts, [])[1:n.h], n.ts[n.h + 1:]) END AS ts
  FROM numbered n LEFT JOIN turns b ON b.c = n.c - n.c % 100
), prefix AS (
  SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt
), node AS (
  SELECT d, ts[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)
                         FILTER (len(ts) = d), '')) AS ends_sha256
  FROM prefix GROUP BY d, ts[1:d]
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id,
         CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.p[n.d].text) END AS saved,
         (SELECT count(*) FROM node k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS n_children
  FROM node n LEFT JOIN node u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
), up AS (
  SELECT a, p[1:a] AS ap, sum(saved) AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM linked) GROUP BY a, p[1:a]
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN up ON up.a = linked.d AND up.ap = linked.p
"""

# Every state after each turn, with at most two turns inserted before one (more never pay).
STRUCTURE_REPAIR = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1
  FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE step = 8
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
                                         || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                            lambda d: CAST(ascii(d) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE k <> 0
), placed AS (
  SELECT *, coalesce(conv_id, -9223372036854775808) AS c,
         row_number() OVER conv AS i, row_number() OVER same > 1 AS again,
         lead(substr(role, 1, 1)) OVER conv AS next_initial,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM damaged
  WINDOW conv AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy),
         same AS (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy)
), row AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
         substr(role, 1, 1) AS initial
  FROM placed
), added(q, letters, cost, q2) AS (
  VALUES (0, '', 0, 0), (0, 'I', 5, 2), (0, 'II', 10, 3), (1, '', 0, 1), (1, 'I', 5, 2),
         (1, 'II', 10, 3), (2, '', 0, 2), (2, 'I', 5, 3), (2, 'II', 10, 2), (3, '', 0, 3),
         (3, 'I', 5, 2), (3, 'II', 10, 3)
), edit(q, letter, cost, initial, q2) AS (
  VALUES (0, 'D', 2, NULL, 0), (1, 'D', 2, NULL, 1), (2, 'D', 2, NULL, 2), (3, 'D', 2, NULL, 3),
         (0, 'K', 0, 's', 1), (0, 'K', 0, 'u', 2), (1, 'K', 0, 'u', 2), (3, 'K', 0, 'u', 2),
         (2, 'K', 0, 'a', 3), (0, 'R', 1, NULL, 2), (1, 'R', 1, NULL, 2), (3, 'R', 1, NULL, 2),
         (2, 'R', 1, NULL, 3)
), step AS (
  SELECT a.q, a.letters || e.letter AS letters, a.cost + e.cost AS cost, e.letter, e.initial, e.q2
  FROM added a JOIN edit e ON e.q = a.q2
), path AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': ''} AS w FROM row
  UNION ALL
  SELECT p.c, r.i, s.q2,
         min({'cost': p.w.cost + s.cost
                      + CASE WHEN r.fault = 'truncated' AND s.letter <> 'D' THEN 5 ELSE 0 END,
              'audit': p.w.audit || s.letters})
  FROM path p JOIN row r ON r.c = p.c AND r.i = p.i + 1 JOIN step s ON s.q = p.q
  WHERE (s.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    AND (s.initial IS NULL OR s.initial = r.initial)
  GROUP BY p.c, r.i, s.q2
), counts AS (
  SELECT c, max(i) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (next_initial IS NOT NULL
                          AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM row GROUP BY c
), chosen AS (
  SELECT n.*, (SELECT min({'cost': p.w.cost + a.cost, 'audit': p.w.audit || a.letters})
               FROM path p JOIN added a ON a.q = p.q
               WHERE p.c = n.c AND p.i = n.n AND a.q2 IN (0, 3)) AS w
  FROM counts n
), letters AS (
  SELECT c, unnest(string_split(w.audit, '')) AS letter,
         unnest(range(1, length(w.audit) + 1)) AS spot
  FROM chosen
), counted AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER so_far AS i,
         count(*) FILTER (letter <> 'D') OVER so_far AS place
  FROM letters WINDOW so_far AS (PARTITION BY c ORDER BY spot)
), kept AS (
  SELECT l.*, r.role, r.text,
         max(CASE WHEN l.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.c)
           AS system
  FROM counted l LEFT JOIN row r ON r.c = l.c AND r.i = l.i AND l.letter <> 'I'
  WHERE l.letter <> 'D'
), repaired AS (
  SELECT c, string_agg(
           CASE WHEN letter = 'K' THEN role
                WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body
  FROM kept GROUP BY c
), every AS (
  SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775808) AS c FROM conversations
)
SELECT e.conv_id, coalesce(w.gaps, 0) AS gaps, coalesce(w.blank, 0) AS blank,
       coalesce(w.duplicate, 0) AS duplicate, coalesce(w.truncated, 0) AS truncated,
       coalesce(w.illegal, 0) AS illegal, CAST(coalesce(w.w.cost, 0) AS BIGINT) AS cost,
       coalesce(w.w.audit, '') AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM every e LEFT JOIN chosen w USING (c) LEFT JOIN repaired r USING (c)
"""
