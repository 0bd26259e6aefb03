"""SimHash components against brute force over all pairs, and edge cases."""

from __future__ import annotations

import random

import pytest
import xxhash

from dealmargin.llm import simhash
from dealmargin.llm.components import component_roots
from dealmargin.operators.joins import settle


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42)
        for i in range(len(words) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    fps = sorted(set(pairs.values()))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for own, f in pairs.items():
        least[find(f)] = min(own, least.get(find(f), own))
    return {own: least[find(f)] for own, f in pairs.items()}


TEXTS = ["", None, " \t\x0b ", "one", "One  TWO", "É a b c d", "a b c d e f g h", "x y " * 70000]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_fingerprint_equals_brute_force(text):
    found = simhash.fingerprint((text or "").encode()) & (1 << 64) - 1
    assert found == brute_fingerprint(text)


def test_components_follow_exactly_the_radius(spark):
    rng = random.Random(5)
    fps = {0, 2**63, 2**64 - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << b
            fps.add(f)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    found = simhash.fingerprint_components(settle(spark.createDataFrame(signed, "_fp long")))
    got = {f[0]: f[0] for f in signed}
    for r in found.collect():
        got[r.node] = r.root
    expected = brute_components({f: f & (1 << 64) - 1 for (f,) in signed})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(expected)


def test_documents_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=300)) for _ in range(5)]
    texts = [*base, *base[:2], base[0] + " z", "", None, "\n", "one", "ONE"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    pairs = {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    expected = brute_components(pairs)
    for r in out:
        if r.doc_id is not None:
            assert r.fingerprint == f"{pairs[r.doc_id]:016x}"
            assert r.component_id == expected[r.doc_id]
    assert [r.component_id for r in out if r.doc_id is None] == [None]


def test_empty_table_and_odd_radius(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=3)


def test_long_chain_and_star_of_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, i) for i in range(101, 180)] + [(7000, 7000)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    roots = {r.node: r.root for r in component_roots(edges, "b", "a").collect()}
    assert all(roots[n] == 1 for n in range(1, 61))
    assert all(roots[n] == 100 for n in range(100, 180))
