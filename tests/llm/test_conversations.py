"""The prefix trie and the repair of conversations against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealmargin.llm import conversation_repair, prefix_trie, registry
from dealmargin.llm.conversation_repair import Turn
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows, slices=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(slices)


def ordered(rows):
    """The turns of each conversation in order, role and text only."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in found.items()}


# --- prefix trie -------------------------------------------------------------------


def rebuilt(rows):
    own = {c: turns for c, turns in ordered(rows).items() if c is not None}
    out = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 6, int(np.fix(c / 100)) * 100
        out[c] = turns if c == head else own.get(head, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    nodes = {}
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        nodes[node] = (
            min(ids),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(ids),
            len(children),
            sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(nodes.values(), key=str)


COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def trie_of(spark, rows, **sizes):
    own = F.col("conv_id")
    found = prefix_trie.prefix_trie(
        prefix_trie.prefixes(
            frame(spark, rows), taken=F.crc32(own.cast("string")) % 6, head=own - own % 100
        ),
        **sizes,
    )
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def some_rows(n, seed=0, repeats=3):
    """Conversations of few different turns, some equal, some longer, some with odd values."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        conv = [0, 7, 100, 250, -30, -100][c % 6] + int(rng.integers(0, 40)) if c % 4 else c * 100
        for turn in range(int(rng.integers(1, 9))):
            role = ["user", "assistant", None, ""][int(rng.integers(0, 4))]
            text = ["hi", "hé", None, "日本語", "x" * 50][int(rng.integers(0, repeats))]
            rows.append((conv, [turn, None][turn == 0 and c % 3 == 0], role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):
    rows = [*some_rows(60, seed, repeats=2 + seed), (None, 1, "user", "no conversation")]
    assert trie_of(spark, rows) == brute_trie(rebuilt(rows))


def test_a_crowded_sketch_changes_nothing(spark):
    """Counters that nearly all collide only send more prefixes to the exact grouping."""
    rows = some_rows(40, 5)
    assert trie_of(spark, rows, max_counters=16) == brute_trie(rebuilt(rows))


def test_the_sketch_proves_most_singletons(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(1, 400) for t in range(6)]
    kept = prefix_trie.prefixes(frame(spark, rows))
    bits = prefix_trie.shared_bits(kept, prefix_trie.counters_for(kept.count()))
    sketch = spark.sparkContext.broadcast(bits)
    found = prefix_trie.screened(kept.persist(), sketch)
    shared = found.where("_shared").count()
    assert 399 <= shared < 399 + 30  # every root, and few false alarms
    tops = found.where("_top").groupBy("_conv").count()
    assert tops.where("count > 1").count() == 0


def test_many_equal_and_long_conversations(spark):
    """A third of the conversations are equal and end at one node, in pieces; one is long."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 2000, 3) for t in range(2)]
    rows += [(c, t, "user", f"own {c}") for c in range(2, 400, 3) for t in range(2)]
    rows += [(5000, t, "assistant", "w" * (t % 7)) for t in range(3000)]
    convs = {c: turns for c, turns in ordered(rows).items()}
    found = prefix_trie.prefix_trie(prefix_trie.prefixes(frame(spark, rows))).collect()
    by_place = {(r.conv_id, r.depth): r for r in found}
    ends = [c for c in convs if convs[c] == convs[1]]
    top = by_place[1, 2]
    assert (top.n_convs, top.n_children, top.n_leaves) == (len(ends), 0, 1)
    assert top.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
    assert top.saved_tokens == (len(ends) - 1) * 6 and by_place[1, 1].saved_tokens == top.saved_tokens * 2
    deep = [r for r in found if r.conv_id == 5000]
    assert sorted(r.depth for r in deep) == list(range(1, 3001))
    assert {(r.n_leaves, r.saved_tokens) for r in deep} == {(1, 0)}
    root = by_place[1, 0]
    assert (root.n_convs, root.parent_conv_id) == (len(convs), None)
    assert root.n_leaves == len({tuple(t) for t in convs.values()})


def test_pieces_of_ends_are_joined_in_order(spark):
    """A node of very many members is hashed from pieces that several tasks have joined."""
    ends = spark.range(-500, 500, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("few")).otherwise("many").cast("binary").alias("_digest"),
        F.col("id").alias("_conv"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {bytes(r._digest): r._sha for r in prefix_trie.listed_ends(ends, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lists = {b"few": [i for i in range(-500, 500) if i % 3 == 0]}
    lists[b"many"] = [i for i in range(-500, 500) if i % 3]
    assert found == {
        d: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for d, ids in lists.items()
    }


def test_trie_of_nothing_of_turnless_and_of_clashing_columns(spark):
    assert prefix_trie.prefix_trie(prefix_trie.prefixes(frame(spark, []))).collect() == []
    # 101 takes 5 turns of a head that is not there and has no more of its own
    rows = [(101, t, "user", "gone") for t in range(2)]
    assert zlib.crc32(b"101") % 6 >= 2
    empty = hashlib.sha256(b"101").hexdigest()
    assert trie_of(spark, rows) == [(101, 0, None, 1, 0, 1, 0, empty)]
    clashing = frame(spark, rows)
    for name in ("_head", "_conv", "_turn", "_role", "_text", "depth", "n_convs"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    found = prefix_trie.prefix_trie(prefix_trie.prefixes(clashing)).collect()
    assert sorted((r.depth, r.n_convs) for r in found) == [(0, 1), (1, 1), (2, 1)]


def test_digests_tell_roles_texts_and_places_apart():
    start = prefix_trie.ROOT
    digests = [
        prefix_trie.extended(start, "a", "bc"), prefix_trie.extended(start, "ab", "c"),
        prefix_trie.extended(start, "", "abc"),
        prefix_trie.extended(prefix_trie.extended(start, "a", "b"), "", "c"),
        prefix_trie.extended(prefix_trie.extended(start, "", "c"), "a", "b"),
    ]
    assert len(set(digests)) == len(digests)


# --- structure repair --------------------------------------------------------------

GOOD = re.compile(r"(s?(ua)+)?")


def brute_repairs(turns, faults):
    """The least cost and its ASCII-least audit, over all edits of each turn and inserted roles."""
    best = None
    options = []
    for turn, fault in zip(turns, faults, strict=True):
        own = [(2, "D", "")]
        if fault in ("sound", "truncated"):
            extra = 5 if fault == "truncated" else 0
            own.append((extra, "K", turn.role[:1] or "?"))
            own += [(1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options.append(own)
    slots = ["", "u", "a", "ua", "au"]
    for chosen in itertools.product(*options):
        base = sum(c for c, _, _ in chosen)
        if best is not None and base > best[0]:
            continue
        for inserted in itertools.product(slots, repeat=len(turns) + 1):
            cost = base + 5 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            roles, audit = inserted[0], "I" * len(inserted[0])
            for (_, letter, role), after in zip(chosen, inserted[1:], strict=True):
                roles += role + after
                audit += letter + "I" * len(after)
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


ROLES = ["user", "assistant", "system", "", "tool", "User"]


@settings(max_examples=40, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(ROLES), st.sampled_from(["Yes.", "No", "", " \t", "Why?", "日本"])),
        max_size=3,
    )
)
def test_lightest_equals_brute_force(pairs):
    turns = [Turn(i, role, text) for i, (role, text) in enumerate(pairs)]
    faults = conversation_repair.faults(turns)
    cost, audit = conversation_repair.lightest(turns, faults)
    assert (cost, audit) == brute_repairs(turns, faults)
    edited = conversation_repair.edited(turns, audit)
    assert GOOD.fullmatch("".join(role[:1] for role, _ in edited))


def dynamic(turns, faults):
    """Least (cost, audit) by state, turn after turn, with whole strings and any inserted turns."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    add = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(found):
        for _ in range(3):
            for q, (c, a) in list(found.items()):
                other = (c + 5, a + "I")
                found[add[q]] = min(found.get(add[q], other), other)
        return found

    found = inserted({0: (0, "")})
    for turn, fault in zip(turns, faults, strict=True):
        new = {}

        def put(q, value, new=new):
            new[q] = min(new.get(q, value), value)

        for q, (c, a) in found.items():
            put(q, (c + 2, a + "D"))
            if fault in ("sound", "truncated"):
                extra = 5 if fault == "truncated" else 0
                if (q, turn.role[:1]) in steps:
                    put(steps[q, turn.role[:1]], (c + extra, a + "K"))
                put(add[q], (c + 1 + extra, a + "R"))
        found = inserted(new)
    return min(found[q] for q in (0, 3) if q in found)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(ROLES), st.sampled_from("a. b. c. d e f g. h. i! j? k l".split(" "))),
        max_size=40,
    )
)
def test_lightest_equals_dynamic_programming(pairs):
    turns = [Turn(i, role, text) for i, (role, text) in enumerate(pairs)]
    faults = conversation_repair.faults(turns)
    assert conversation_repair.lightest(turns, faults) == dynamic(turns, faults)


def test_long_conversations_take_linear_work():
    """Audits are shared, so that a hundred thousand turns are no matter of a string each."""
    turns = [Turn(i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(100_000)]
    assert conversation_repair.lightest(turns, ["sound"] * len(turns)) == (0, "K" * len(turns))
    cost, audit = conversation_repair.lightest(turns[1:], ["sound"] * (len(turns) - 1))
    assert (cost, audit) == (2, "D" + "K" * (len(turns) - 2))


def brute_repair(rows):
    """Everything the operator returns for one conversation's (turn, role, text) rows."""
    turns = sorted(((t is not None, t or 0, r or "", x or ""), t) for t, r, x in rows)
    listed = [Turn(t, key[2], key[3]) for key, t in turns]
    faults, seen = [], set()
    for turn in listed:
        solid = turn.text.strip(" \t\n\x0b\x0c\r")
        if not solid:
            faults.append("blank")
        elif (turn.role, turn.text) in seen:
            faults.append("duplicate")
        else:
            faults.append("sound" if solid[-1] in ".!?" else "truncated")
        seen.add((turn.role, turn.text))
    cost, audit = dynamic(listed, faults)
    numbers = {t.number for t in listed if t.number is not None}
    initials = [t.role[:1] for t in listed]
    out, state, left = [], "", iter(listed)
    for letter in audit:
        turn = next(left) if letter != "I" else Turn(None, "", "")
        if letter == "D":
            continue
        role = turn.role if letter == "K" else ("assistant" if state == "u" else "user")
        state = role[:1]
        out.append((role, turn.text))
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        cost, audit, out,
    )


def repairs_of(found):
    return {
        r.conv_id: (
            r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
            [(t.role, t.text) for t in r.repaired],
        )
        for r in found.collect()
    }


def brute_all(rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(rest)
    return {conv: brute_repair(turns) for conv, turns in groups.items()}


def test_operator_equals_brute_force(spark):
    """NULLs in every column, ties, repeated rows, blanks of every kind."""
    rows = some_rows(40, 3)
    rows += [
        (None, 1, "user", "Hello."), (None, 3, "assistant", "Yes!"),
        (900, None, None, None), (900, None, "user", "A."), (900, 5, "user", "A."),
        (901, 2, "system", "S."), (901, 2, "system", "S."), (901, 9, "user", "no end\n"),
        (902, 1, "assistant", "\x0b\x0c"), (903, -4, "user", "Q?"), (903, 4, "assistant", "R. \t"),
        (904, 1, "user", " "),
    ]
    assert repairs_of(conversation_repair.repaired_conversations(frame(spark, rows))) == brute_all(rows)


def test_small_batches_no_rows_long_texts_and_clashing_columns(spark):
    rows = some_rows(30, 9) + [(77, t, "user", "long " * 200_000 + ".") for t in range(2)]
    clashing = frame(spark, rows)
    for name in ("_conv", "_turn", "_role", "_text", "audit", "cost", "repaired"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = repairs_of(conversation_repair.repaired_conversations(clashing))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute_all(rows)
    assert conversation_repair.repaired_conversations(frame(spark, [])).collect() == []


def test_damage_and_digests_of_the_query(spark, tmp_path):
    """The registered query on rows of the table and odd ones, its damage done by hand."""
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    rows = table + some_rows(60, 1) + [(None, None, None, None), (8888, None, None, "x")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        copies = {0: 0, 3: 2}.get(kind, 1)
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * copies
    mended = brute_all(damaged)
    found = registry.op13_conversation_structure_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id for r in found} == {r[0] for r in rows} and len(found) == len({r[0] for r in rows})
    for r in found:
        *counts, out = mended.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", []))
        body = "\n".join(f"{role}:{text}" for role, text in out)
        assert tuple(r)[1:] == (*counts, hashlib.sha256(body.encode()).hexdigest())
