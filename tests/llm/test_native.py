"""Line dedup, sharding, URL filter and decontamination against brute force on odd inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dealmargin.llm import bloom, decontamination, line_dedup, registry, sharding, url_filter

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- line dedup --------------------------------------------------------------------


def brute_lines(rows):
    holders = defaultdict(set)
    keyed = []
    for own, text in rows:
        lines = (text or "").split("\n")
        keys = [lower(line.strip(BLANKS)) for line in lines]
        keyed.append((own, lines, keys))
        for k in keys:
            if len(k) >= 20:
                holders[k].add(own)
    out = []
    for own, lines, keys in keyed:
        kept = [
            line
            for line, k in zip(lines, keys, strict=True)
            if len(holders[k]) < 3 or own == max(holders[k], key=lambda o: (o is not None, o or 0))
        ]
        out.append((own, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_shared_lines(spark):
    rng = random.Random(2)
    long = ["A line that is shared by many", "  a line THAT is shared by many\t", "É" * 20, "é" * 20,
            "exactly twenty chars", "only nineteen chars", "", " ", "x" * 500]
    rows = [(i, "\n".join(rng.choices(long, k=rng.randrange(6)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (7, rows[7][1]), (8, "another text " * 3),
             (None, long[0]), (None, long[0] + "\n" + long[4]), (50, (long[0] + "\n") * 3000)]
    docs = spark.createDataFrame(
        [(*r, 1) for r in rows], "doc_id long, text string, N_Lines int"
    )
    out = line_dedup.drop_shared_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_lines(rows)
    assert line_dedup.drop_shared_lines(docs.limit(0)).collect() == []


# --- sharding ----------------------------------------------------------------------


def test_shards_hold_the_mixture(spark):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None), "c") for i in range(3000)]
    rows += [(1, "big", "c")] * 5 + [(None, "big", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = sharding.interleaved_shards(docs, 7).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[1]) for r in rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    sizes = [len(s) for s in shards.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    whole = Counter(r[1] for r in rows)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for source, n in Counter(r.source for r in own).items():
            assert abs(n - whole[source] * len(own) / len(rows)) <= 2
    again = sharding.interleaved_shards(docs.repartition(5), 7).collect()
    unique = lambda out: {r.doc_id: (r.shard, r.slot) for r in out if r.doc_id not in (1, None)}
    assert unique(out) == unique(again)
    few = sharding.interleaved_shards(docs.limit(3), 7).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]
    assert sharding.interleaved_shards(docs.limit(0), 7).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s") for i in range(50)], "doc_id long, source string")
    sharding.write_shards(sharding.interleaved_shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# --- URL filter --------------------------------------------------------------------

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("x://h?a/b", "h", "", None, "allow"),
        ("https://www.listed.org/a/?utm_x=1&p=2#z", "www.listed.org", "/a/", None, "block"),
        ("HTTP://LISTED.org/a?p=2", "listed.org", "/a", None, "block"),
        ("http://listed.org/A?p=2", "listed.org", "/A", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "c")], "page_id long, url string, Rule string")
    listed = spark.createDataFrame(
        [("http://m.listed.org/a?p=2",), (None,), ("http://m.listed.org/a/?p=2",)], "url string"
    )
    (row,) = url_filter.filter_urls(pages, listed, RULES).collect()
    assert row.asDict() == {
        "page_id": 1, "url": url, "host": host, "path": path, "rule": rule, "verdict": verdict
    }


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)
    pages = spark.range(3000).selectExpr("id page_id", "concat('http://h/', id) url")
    listed = pages.where("page_id % 3 = 0").select("url")
    out = url_filter.filter_urls(pages.union(pages.limit(1)), listed)
    assert out.where("verdict = 'block'").count() in (1000, 1001)
    assert out.where("(verdict = 'block') <> (page_id % 3 = 0)").count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).collect() == []


# --- decontamination ---------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def brute_hits(text, items):
    doc = words(text)
    hit, found = set(), set()
    for own, body in items:
        item = words(body)
        span = min(10, len(item))
        windows = {tuple(item[i : i + span]) for i in range(len(item) - span + 1)} if item else set()
        for i in range(len(doc) - span + 1):
            if span and tuple(doc[i : i + span]) in windows:
                hit.update(range(i, i + span))
                found.add(own)
    return len(doc), len(hit), sorted(str(o) for o in found if o is not None)


@pytest.mark.parametrize("rows", [50_000, 0], ids=["broadcast", "shuffled"])
def test_contamination(spark, rows):
    rng = random.Random(8)
    vocabulary = ["a", "b", "Cé", "d1", "e"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 7, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, "one two"), (21, None), (22, "--"), (None, "solo words here"), (3, "x y z"), (5, items[0][1])]
    texts = [None, "", "...", "one", "one, TWO!", "solo words here", "q " * 600 + items[3][1] + " q" * 300]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(40)]
    texts += [
        " zz ".join(rng.choice(items[:12])[1].replace(" ", "; ") for _ in range(3)) for _ in range(40)
    ]
    texts += ["a a " * 700, " ".join(i[1] for i in items[:12]) * 20]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, "one two"), (None, "one two"), (4, texts[4])]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, n_hit string")
    listed = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(frame, listed, broadcast_rows=rows).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=repr)
    assert got == sorted(((i, *brute_hits(t, items)) for i, t in docs), key=repr)
    clean = decontamination.without_contaminated(frame, listed, broadcast_rows=rows)
    assert clean.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(
        d for d in docs if not brute_hits(d[1], items)[1]
    )


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    (row,) = decontamination.contamination(docs, items.limit(0)).collect()
    assert (row.n_words, row.n_hit, list(row["items"])) == (2, 0, [])


# --- columns of any name -----------------------------------------------------------


def clashing(rows, *names):
    """Rows with further columns called like the operators' own, each with a value to look for."""
    for name in names:
        rows = rows.withColumn(name, F.concat(F.lit(f"my {name} "), F.col(rows.columns[0]).cast("string")))
    return rows


def untouched(out, own, names):
    rows = out.select(own, *names).collect()
    assert rows
    assert all(r[n] == f"my {n} {r[own]}" for r in rows for n in names)


BLOOM = ("_own", "_id", "_hash", "_pair", "_maybe", "_block", "_gone", "_gone_hash",
         *(f"_w{i}" for i in range(8)))


def test_clashing_columns_pass_through(spark):
    line = "a line that all of the documents share"
    docs = spark.createDataFrame(
        [(i, f"{line}\nown {i}", "ab"[i % 2]) for i in range(6)], "doc_id long, text string, source string"
    )
    names = (*BLOOM, "_row", "_at", "_key", "_h", "_g", "_lost", "_lost_id", "_lost_row", "_dropped",
             "_lines", "_text", "_keeper")
    out = line_dedup.drop_shared_lines(clashing(docs, *names))
    assert sorted(r.n_dropped for r in out.collect()) == [0, 1, 1, 1, 1, 1]
    untouched(out, "doc_id", names)
    names = ("_own", "_stratum", "_key", "_bucket", "_rank", "_of", "_fraction", "_part", "_place",
             "_all", "_n", "_before", "_row", "_id")
    out = sharding.interleaved_shards(clashing(docs, *names), 3)
    assert sorted(r.shard for r in out.collect()) == [0, 0, 1, 1, 2, 2]
    untouched(out, "doc_id", names)
    lost = docs.where("doc_id < 2").select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = bloom.without_rows(clashing(docs, *BLOOM), lost, "doc_id", "text", "doc_id", "text_hash")
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 5]
    untouched(out, "doc_id", BLOOM)


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame(
        [(i, f"http://h.org/{i}") for i in range(6)], "page_id long, url string"
    )
    names = (*BLOOM, "_canonical", "_ruled", "_in", "_listed")
    out = url_filter.filter_urls(clashing(pages, *names), pages.where("page_id = 3"), RULES)
    assert [r.page_id for r in out.where("verdict = 'block'").collect()] == [3]
    untouched(out, "page_id", names)


def test_the_listing_is_there_at_every_size(spark):
    for size in ("sf0.001", "sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select("page_id", "url")
        judged = registry.op9_url_filter(spark, f"/root/testdata/{size}")
        listed = registry.listed_urls(pages).distinct().count()
        blocked = judged.where("verdict = 'block' AND rule IS NULL").count()
        assert 0 < blocked <= pages.count() // 8 and listed <= blocked * 3


def test_very_long_texts(spark):
    line = "a line that all of the documents share"
    body = f"{line}\n" + "\n".join(f"own line {i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, body), (2, line), (3, line + "\n" + body)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.drop_shared_lines(docs, min_documents=3).collect()}
    assert (out[1].n_lines, out[1].n_dropped, out[3].n_dropped) == (100_001, 1, 0)
    assert out[1].text == body[len(line) + 1 :] and out[2].text == ""


def test_a_document_that_loses_very_many_lines(spark):
    """Linear in the lines lost; neither the lines nor the gaps are formed again for each."""
    body = "\n".join(f"a shared line of number {i}" for i in range(30_000))
    docs = spark.createDataFrame([(i, body) for i in range(3)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.drop_shared_lines(docs).collect()}
    assert [(out[i].n_dropped, out[i].text) for i in range(3)] == [(30_000, ""), (30_000, ""), (0, body)]
