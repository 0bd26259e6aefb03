"""What the result grid does to its rows, for any DataFrame: filter, sort, total, update."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType

from dealmargin.operators.joins import spread_join


class Condition(NamedTuple):
    """One filter condition; to is the upper bound of inRange."""

    op: str
    value: object = None
    to: object = None


class Either(NamedTuple):
    """Conditions on one column of which any may hold."""

    conditions: tuple[Condition, ...]


class Both(NamedTuple):
    """Conditions on one column which must all hold."""

    conditions: tuple[Condition, ...]


Filter = Condition | Either | Both

_TEXT = {
    "contains": lambda text, value: text.contains(value),
    "equals": lambda text, value: text == value,
    "startsWith": lambda text, value: text.startswith(value),
    "endsWith": lambda text, value: text.endswith(value),
}
_NUMBER = {
    "equals": lambda number, value: number == value,
    "notEqual": lambda number, value: number != value,
    "lessThan": lambda number, value: number < value,
    "lessThanOrEqual": lambda number, value: number <= value,
    "greaterThan": lambda number, value: number > value,
    "greaterThanOrEqual": lambda number, value: number >= value,
}


def text_condition(column: Column, condition: Condition) -> Column:
    """Case-insensitive text filter. A NULL contains, equals and starts with nothing."""
    if condition.op in ("blank", "notBlank"):
        blank = F.coalesce(column, F.lit("")) == ""
        return blank if condition.op == "blank" else ~blank
    text, value = F.lower(column), F.lower(F.lit(condition.value))
    if condition.op in ("notContains", "notEqual"):
        positive = "contains" if condition.op == "notContains" else "equals"
        return ~F.coalesce(_TEXT[positive](text, value), F.lit(False))
    return _TEXT[condition.op](text, value)


def number_condition(column: Column, condition: Condition) -> Column:
    """Numeric filter; inRange includes both bounds. NULL satisfies only blank."""
    if condition.op == "blank":
        return column.isNull()
    if condition.op == "notBlank":
        return column.isNotNull()
    if condition.op == "inRange":
        return column.between(F.lit(condition.value), F.lit(condition.to))
    return _NUMBER[condition.op](column, F.lit(condition.value))


def _is_number(rows: DataFrame, name: str) -> bool:
    kind = rows.schema[name].dataType.typeName()
    return kind in ("byte", "short", "integer", "long", "float", "double", "decimal")


def filter_predicate(rows: DataFrame, name: str, wanted: Filter) -> Column:
    """The predicate of one column, numeric or text by the column's type."""
    build = number_condition if _is_number(rows, name) else text_condition
    column = F.col(name) if _is_number(rows, name) else F.col(name).cast("string")
    if isinstance(wanted, Condition):
        return build(column, wanted)
    parts = [build(column, condition) for condition in wanted.conditions]
    join = (lambda a, b: a | b) if isinstance(wanted, Either) else (lambda a, b: a & b)
    return reduce(join, parts)


def grid_filter(rows: DataFrame, filters: Mapping[str, Filter]) -> DataFrame:
    """Rows satisfying the filters of all given columns."""
    for name, wanted in filters.items():
        rows = rows.where(filter_predicate(rows, name, wanted))
    return rows


def apply_sort(rows: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows by the given columns, each asc, desc or none; NULLs first ascending, last descending.

    A stable sort: ties keep the order in which the rows come, whatever it is.
    Each row carries its place, its partition's number and its number within
    it, which also lets a value that most rows share sort in several tasks.
    """
    keys = [
        F.col(name).asc_nulls_first() if way == "asc" else F.col(name).desc_nulls_last()
        for name, way in order
        if way != "none"
    ]
    if not keys:
        return rows
    place = free_name(rows, "place")
    placed = rows.withColumn(place, F.monotonically_increasing_id())
    return placed.orderBy(*keys, place).drop(place)


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the rows do not have, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _sum_type(kind: DataType) -> DataType:
    """Sums of decimals keep ten more digits than the summed values."""
    if isinstance(kind, DecimalType):
        return DecimalType(min(38, kind.precision + 10), kind.scale)
    return kind


def totals_row(rows: DataFrame, sums: Sequence[str], label: str, text: str) -> DataFrame:
    """One row of plain sums in the shape of rows, with text in its label column.

    Other text columns are empty and everything else NULL. No rows sum to 0.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    total = rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums])

    def cell(name: str) -> Column:
        if name in sums:
            return F.col(name).cast(_sum_type(kinds[name]))
        if isinstance(kinds[name], StringType):
            return F.lit(text if name == label else "")
        return F.lit(None).cast(kinds[name])

    return total.select(*[cell(name).alias(name) for name in rows.columns])


def grid_totals(
    rows: DataFrame, sums: Sequence[str], label: str, text: str = "합계"
) -> DataFrame:
    """The rows followed by their totals row. Sides and signs are not looked at."""
    totals = totals_row(rows, sums, label, text)
    widened = rows.select(
        *[
            F.col(name).cast(totals.schema[name].dataType) if name in sums else F.col(name)
            for name in rows.columns
        ]
    )
    return widened.unionByName(totals)


def _applicable(key: str, seq: str) -> Column:
    return F.col(key).isNotNull() & F.col(seq).isNotNull()


def update_rejects(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The changes that update_rows cannot apply to anyone, with the reason."""
    reason = F.when(F.col(key).isNull(), "no key").when(F.col(seq).isNull(), "no sequence")
    return changes.withColumn("reason", reason).where(F.col("reason").isNotNull())


def update_rows(
    rows: DataFrame,
    changes: DataFrame,
    key: str,
    seq: str,
    sent: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows with the changed fields merged in by key, each field from the last change that sends it.

    sent names, for a field, the boolean column of the changes that tells
    whether a change sends it; a field without one is sent by every change. A
    field that is not sent stays as it is, one sent as NULL becomes NULL, and so
    every row without a change stays. Changes without a key or a sequence are
    not applied, see update_rejects. Of changes of a key with one sequence a
    hash of their fields decides.

    Per key and field only numbers are aggregated, the last sequence and then
    the hash, in place and before the shuffle; values are fetched by a join
    from the few changes that won.
    """
    flags = dict(sent or {})
    fields = [c for c in changes.columns if c not in (key, seq, *flags.values()) and c in rows.columns]
    if not fields:
        return rows
    numbered = changes.where(_applicable(key, seq)).select(
        F.col(key).alias("_key"),
        F.col(seq).alias("_seq"),
        F.xxhash64(*fields).alias("_hash"),
        F.struct(*[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)]).alias("_values"),
        *[
            (F.coalesce(F.col(flags[f]), F.lit(False)) if f in flags else F.lit(True)).alias(f"_sent{i}")
            for i, f in enumerate(fields)
        ],
    )
    every = range(len(fields))

    def last(found: DataFrame, number: str, known: str | None = None) -> DataFrame:
        """The greatest number of each key and field, of its changes that are still in question."""
        picked = {i: F.col(f"_sent{i}") for i in every}
        if known is not None:
            picked = {i: p & (F.col("_seq") == F.col(f"{known}{i}")) for i, p in picked.items()}
        tops = found.groupBy("_key").agg(
            *[F.max(F.when(p, F.col(number))).alias(f"_last{number}{i}") for i, p in picked.items()]
        )
        met = spread_join(found, tops, ["_key"], "inner")
        own = [p & (F.col(number) == F.col(f"_last{number}{i}")) for i, p in picked.items()]
        return met.where(reduce(lambda a, b: a | b, own))

    won = last(last(numbered, "_seq"), "_hash", "_last_seq")
    at = [f"{name}{i}" for name in ("_last_seq", "_last_hash") for i in every]
    merged = won.groupBy("_key", *at).agg(
        F.collect_set(F.struct("_seq", "_hash", "_values")).alias("_won")
    )

    def value(i: int) -> Column:
        chosen = F.filter(
            "_won",
            lambda c: (c["_seq"] == F.col(f"_last_seq{i}")) & (c["_hash"] == F.col(f"_last_hash{i}")),
        )
        return F.get(chosen, F.lit(0))["_values"][f"v{i}"]

    updates = merged.select(
        F.col("_key"),
        F.struct(*[F.col(f"_last_seq{i}").isNotNull().alias(f"s{i}") for i in every]).alias("_sent"),
        F.struct(*[value(i).alias(f"v{i}") for i in every]).alias("_new"),
    )
    number = {f: i for i, f in enumerate(fields)}
    joined = spread_join(
        rows.select(F.col(key).alias("_key"), F.struct(*rows.columns).alias("_own")),
        updates,
        ["_key"],
        "left",
        F.xxhash64("_own"),
    )
    return joined.select(
        *[
            F.when(F.col(f"_sent.s{number[c]}"), F.col(f"_new.v{number[c]}"))
            .otherwise(F.col("_own")[c])
            .alias(c)
            if c in number
            else F.col("_own")[c].alias(c)
            for c in rows.columns
        ]
    )


def fetch_all(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return rows.select(*columns) if columns else rows


def fetch_one(rows: DataFrame) -> DataFrame:
    """The first row or none; without an order any row may come first."""
    return rows.limit(1)


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """A few rows to look at: the first of an ordered frame, else any of them."""
    return rows.limit(n)


def row_count(rows: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows with their number observed by whichever job reads them first."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("row_count")), seen
