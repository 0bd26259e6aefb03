"""Packing against the reference tokenizer, with an exact round trip and its limits."""

from __future__ import annotations

from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Reference

from dealmargin.llm import packing
from dealmargin.llm.packing import Limits, Piece, cut_into_bins, dot_product_bins

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
REFERENCE = Reference.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = st.sampled_from(
    ["a", " ", "  ", "\n", "\t", "é", "x's", "1２", "<|endoftext|>", "\xa0", " b", ".", "ß\n", "漢"]
)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(WORDS).map("".join), st.text()))
def test_ids_equal_the_reference(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert list(array("I", packing.tokenizer(RANKS).encode(text))) == ids


def test_cache_is_cleared_not_exceeded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 3)
    own = packing.Tokenizer(RANKS)
    text = "one two three four five six one two"
    for _ in range(2):
        ids = REFERENCE.encode(text, add_special_tokens=False).ids
        assert list(array("I", own.encode(text))) == ids


def pieces(lengths, loss_from=0):
    return [Piece(i, 0, bytes(4 * n), n, loss_from) for i, n in enumerate(lengths)]


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 50), st.integers(0, 60)), max_size=60),
    st.integers(1, 6),
    st.integers(10, 49),
)
def test_bins_keep_every_limit(sizes, segments, loss):
    limits = Limits(50, segments, loss)
    own = [Piece(i, 0, bytes(4 * n), n, f) for i, (n, f) in enumerate(sizes)]
    fitting = [p for p in own if p.loss <= loss]
    for bins, put in ((dot_product_bins(fitting, limits), fitting), (cut_into_bins(own, limits), own)):
        for b in bins:
            assert sum(p.tokens for p in b) <= 50
            assert len(b) <= segments
            assert sum(p.loss for p in b) <= loss
        assert sum(p.tokens for b in bins for p in b) == sum(p.tokens for p in put)


def test_dot_product_prefers_what_fills_the_bin():
    bins = dot_product_bins(pieces([6, 5, 4, 3, 2]), Limits(10, 9, 10))
    assert [[p.tokens for p in b] for b in bins] == [[6, 4], [5, 3, 2]]


@pytest.fixture(scope="module")
def packed(spark):
    texts = ["", None, "One two. ", "x " * 3000, "<|endoftext|> a", "ends\n", " lead"] + ["w y"] * 40
    rows = [(i, t, 5 if i == 3 else None) for i, t in enumerate(texts)] + [(2, "One two. ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    out = packing.pack_documents(docs, RANKS, Limits(128, 4, 100), loss_from_column="prompt")
    return rows, out.collect()


def test_round_trip_of_every_document(packed):
    rows, out = packed
    found = defaultdict(list)
    for r in out:
        found[r.doc_id].append((r.start, list(array("I", bytes(r.ids)))))
    for own, text, _ in rows:
        expected = [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for r in rows if r[0] == own)
        assert sorted(i for _, ids in found[own] for i in ids) == sorted(expected * copies)
        if copies == 1:
            assert [i for _, ids in sorted(found[own]) for i in ids] == expected


def test_sequences_are_gapless_and_within_the_limits(packed):
    _, out = packed
    sequences = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        loss = sum(
            max(0, r.start + r.length - max(5 if r.doc_id == 3 else 0, r.start + 1)) for r in own
        )
        assert at <= 128 and len(own) <= 4 and loss <= 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, RANKS).collect() == []
