"""Grid operators on ties, on fields that are not sent, and on what a CSV file can lose."""

from __future__ import annotations

import csv
import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dealmargin.operators import export, grid
from tests.conftest import rows_of


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sort --------------------------------------------------------------------------


@pytest.mark.parametrize("order", [
    [("a", "asc")], [("a", "desc")], [("a", "asc"), ("b", "desc")], [("b", "asc"), ("a", "none")],
])
def test_ties_keep_the_input_order(spark, order):
    """Against Python's stable sort, over rows of several partitions in no order of their own."""
    rows = spark.range(0, 4000, 1, 7).select(
        F.when(F.xxhash64("id") % 5 != 0, F.xxhash64("id") % 3).alias("a"),
        (F.xxhash64(F.lit(1), "id") % 2).alias("b"),
        "id",
        F.lit("kept").alias("place"),
    )
    given = [tuple(r) for r in rows.collect()]
    expected = list(given)
    for name, way in reversed(order):
        at = rows.columns.index(name)
        if way == "asc":
            expected.sort(key=lambda r: (r[at] is not None, r[at] or 0))
        elif way == "desc":
            expected.sort(key=lambda r: (r[at] is None, -(r[at] or 0)))
    found = grid.apply_sort(rows, order)
    assert found.columns == rows.columns
    assert [tuple(r) for r in found.collect()] == expected


def test_a_value_most_rows_share_sorts_in_several_tasks(spark):
    """Ranges are cut within the value, as each row has a place of its own."""
    rows = spark.range(0, 20000, 1, 8).select(F.lit(1).alias("a"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = grid.apply_sort(rows, [("a", "asc")])
        sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 2 and min(r["count"] for r in sizes) > 5000


# --- update ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Kim", 10, "a"), (2, "Su", 20, "b"), (3, "Lee", 30, "c"), (None, "Kang", 5, "d")],
        "id long, name string, score int, note string",
    )


CHANGES = "seq long, id long, name string, has_name boolean, score int, has_score boolean"


def test_fields_are_merged_one_by_one(spark, people):
    """A field not sent stays, one sent as NULL becomes NULL, a later one wins over an earlier."""
    changes = spark.createDataFrame(
        [
            (1, 1, "first", True, 11, True), (2, 1, "later", True, 99, False),
            (3, 1, "never", False, None, True), (1, 2, None, True, 21, None),
            (5, None, "x", True, 1, True), (None, 3, "y", True, 1, True), (1, 9, "z", True, 1, True),
        ],
        CHANGES,
    )
    sent = {"name": "has_name", "score": "has_score"}
    found = grid.update_rows(people, changes, "id", "seq", sent)
    assert found.columns == people.columns
    assert {r.id: (r.name, r.score, r.note) for r in found.collect()} == {
        1: ("later", None, "a"), 2: (None, 20, "b"), 3: ("Lee", 30, "c"), None: ("Kang", 5, "d")
    }
    rejects = grid.update_rejects(changes, "id", "seq").collect()
    assert sorted((r.name, r.reason) for r in rejects) == [("x", "no key"), ("y", "no sequence")]


def test_update_without_changes_repeated_and_negative_sequences(spark, people):
    none = spark.createDataFrame([], "seq long, id long, name string")
    assert rows_of(grid.update_rows(people, none, "id", "seq")) == rows_of(people)
    changes = spark.createDataFrame(
        [(-5, 1, "old"), (-2, 1, "new"), (7, 2, "same"), (7, 2, "same"), (7, 3, "p"), (7, 3, "q")],
        "seq long, id long, name string",
    )
    found = [
        {r.id: r.name for r in grid.update_rows(people, c, "id", "seq").collect()}
        for c in (changes, changes.orderBy(F.desc("name")))
    ]
    assert found[0] == found[1]
    assert found[0].pop(3) in ("p", "q")
    assert found[0] == {1: "new", 2: "same", None: "Kang"}


def test_update_aggregates_numbers_without_sorts(spark, people):
    changes = spark.range(0, 1000).select(
        (F.col("id") % 3).alias("id"), F.col("id").alias("seq"), F.lit("n").alias("name")
    )
    text = plan_text(grid.update_rows(people, changes, "id", "seq"))
    assert "SortAggregate" not in text


def test_a_hot_key_of_changes_is_reduced_before_the_shuffle(spark, people):
    changes = spark.range(0, 50000, 1, 4).select(
        F.lit(1).cast("long").alias("id"), F.col("id").alias("seq"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
    )
    found = grid.update_rows(people, changes, "id", "seq")
    assert {r.id: r.name for r in found.collect()}[1] == "n49999"
    assert "partial_max" in plan_text(found)


# --- CSV ---------------------------------------------------------------------------

TRICKY = [
    (1, None, None), (2, "", 1), (3, "\\N", 2), (4, "\\\\N", 3), (5, 'say "hi", twice', None),
    (6, "two\nlines", 4), (7, "  spaced  ", 5), (8, "N", 6), (9, '""', 7), (10, "back\\slash", 8),
    (11, "a,b", 9), (12, "\\", 10),
]


def test_csv_gives_back_every_text(spark, tmp_path):
    rows = spark.createDataFrame(TRICKY, "id long, note string, n int")
    path = str(tmp_path / "csv")
    export.export_csv(rows, path)
    back = export.read_csv(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect())) == TRICKY


def test_csv_parts_by_name_are_in_order(spark, tmp_path):
    """Read as plain files, one after the other, and by Python's own reader."""
    rows = spark.range(0, 5000, 1, 6).select(
        (F.xxhash64("id") % 1000).alias("n"), F.when(F.col("id") % 3 > 0, "x").alias("note"), "id"
    )
    path = tmp_path / "ordered"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        export.export_csv(rows, str(path), [F.col("n").desc(), F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = sorted(Path(path).glob("part-*.csv"))
    assert len(parts) > 1
    read = [line for part in parts for line in list(csv.reader(part.open()))[1:]]
    expected = sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[2]))
    assert [(int(n), None if note == "\\N" else note, int(i)) for n, note, i in read] == expected


def test_csv_of_nothing_and_of_other_types(spark, tmp_path):
    rows = spark.createDataFrame(
        [(datetime.date(2026, 1, 2), None), (None, True)], "day date, flag boolean"
    )
    path = str(tmp_path / "typed")
    export.export_csv(rows, path)
    assert rows_of(export.read_csv(spark, path, rows.schema)) == rows_of(rows)
    export.export_csv(rows.limit(0), path)
    assert export.read_csv(spark, path, rows.schema).collect() == []
