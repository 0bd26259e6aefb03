"""Content sort against grouping by hand, with hot texts cut over many ranges."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealmargin.llm import exact_dedup


def brute(rows, largest, normalise=lambda t: t):
    """Per id and text: keep_id, group_size and the hash; how many rows of a group stay is one."""
    groups = defaultdict(list)
    for own, text in rows:
        groups[normalise(text or "")].append(own)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(own, keep, len(ids), sha) for own in ids]
    return sorted(out, key=str)


def check(found, rows, largest, normalise=lambda t: t):
    found = found.collect()
    assert sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str
    ) == brute(rows, largest, normalise)
    kept = defaultdict(list)
    for r in found:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert set(kept) == {r.text_sha256 for r in found}
    assert all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in kept.values())


def frame(spark, rows, slices=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)


TEXTS = ["", None, "a", "A", "a ", "b" * 100, "b" * 100 + "c", "b" * 99, "é", "é", "日本", "\x00"]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 2, 7])
def test_runs_over_edges_of_ranges(spark, keep, parts):
    """Two hot texts, one of them empty, are a third of the rows each; ids repeat, some are NULL."""
    rows = [(i, ["hot", "", f"own {i % 50}"][i % 3]) for i in range(300)]
    rows += [(i, TEXTS[i % len(TEXTS)]) for i in range(300, 340)]
    rows += [(5, "hot"), (5, "hot"), (None, "hot"), (None, "only null"), (None, "only null"), (7, None)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(exact_dedup.exact_duplicates(frame(spark, rows), keep=keep), rows, keep == "largest")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_hot_text_is_cut_over_tasks(spark):
    rows = spark.range(0, 40000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = exact_dedup.content_sorted(rows, "doc_id", F.col("text"), largest=False)
        sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 10000
        found = exact_dedup.exact_duplicates(rows)
        assert found.where("kept").select("doc_id", "keep_id", "group_size").collect() == [(0, 0, 40000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_small_batches_give_the_same(spark):
    rows = [(i, f"text {i % 7}" if i % 2 else "x" * (i % 5)) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(exact_dedup.exact_duplicates(frame(spark, rows)), rows, largest=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_normalised_texts_and_other_id_types(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a c"), (4, None)]
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("int"))
    found = exact_dedup.exact_duplicates(docs, normalise=F.lower)
    check(found, rows, largest=False, normalise=str.lower)


def test_no_rows_very_long_texts_and_clashing_columns(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []
    long_text = "wörter " * 300_000
    rows = [(1, long_text), (2, long_text + "."), (3, long_text), (4, "short")]
    clashing = frame(spark, rows)
    for name in ("_text", "_id", "_lead", "_hash", "_edge", "keep_id", "kept", "group_size"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    found = exact_dedup.exact_duplicates(clashing, keep="largest")
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(found, rows, largest=True)
    with pytest.raises(ValueError, match="smallest or largest"):
        exact_dedup.exact_duplicates(clashing, keep="first")


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(-3, 9) | st.none(), st.sampled_from(TEXTS)), max_size=40))
def test_any_rows(spark, rows):
    check(exact_dedup.exact_duplicates(frame(spark, rows)), rows, largest=False)
