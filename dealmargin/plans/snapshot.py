"""Dated snapshots of the profit and loss: checking, writing, looking up."""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmargin.functions.dates import parse_date
from dealmargin.operators.joins import settle
from dealmargin.sources.schemas import SNAPSHOT
from dealmargin.sources.versions import Version, VersionedFolder

# The widths of the snapshot's text columns.
TEXT_WIDTHS = {"doc_id": 50, "doc_name": 200}
LOOKUP_COLUMNS = tuple(f.name for f in SNAPSHOT.fields if f.name != "criteria_date")


def _reasons(pnl: DataFrame) -> Column:
    """Why a row does not fit the snapshot's columns; NULL where it fits."""
    checks = [
        F.when(F.char_length(name) > width, f"{name} too long")
        for name, width in TEXT_WIDTHS.items()
    ]
    for field in SNAPSHOT.fields:
        if field.dataType.typeName() == "decimal":
            lost = F.col(field.name).isNotNull() & F.col(field.name).try_cast(
                field.dataType
            ).isNull()
            checks.append(F.when(lost, f"{field.name} out of range"))
    checks.append(F.when(F.col("criteria_date").isNull(), "criteria_date missing"))
    return F.nullif(F.concat_ws("; ", *checks), F.lit(""))


def _judged(dated_pnl: DataFrame) -> DataFrame:
    rows = dated_pnl.select(*LOOKUP_COLUMNS, F.col("date_payment").alias("criteria_date"))
    return rows.withColumn("reason", _reasons(rows))


def snapshot_rows(dated_pnl: DataFrame) -> DataFrame:
    """The rows of a dated profit and loss that fit the snapshot, in its column types."""
    fitting = _judged(dated_pnl).where(F.col("reason").isNull())
    return fitting.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields]
    )


def snapshot_rejects(dated_pnl: DataFrame) -> DataFrame:
    """The rows left out of the snapshot, with the reason."""
    return _judged(dated_pnl).where(F.col("reason").isNotNull())


def _dates_rows(rows: DataFrame) -> DataFrame:
    """Rebalanced by date: a few files of even size, and several tasks for a date of many rows."""
    return rows.hint("rebalance", F.col("criteria_date"))


def write_snapshot(rows: DataFrame, path: str) -> Version:
    """Replace the snapshot's rows of exactly the dates present in rows, in one commit."""
    store = VersionedFolder(rows.sparkSession, path)
    base = store.current()
    fresh = store.add(base, _dates_rows(rows), "criteria_date")
    return store.commit(base, {**base.parts, **fresh}) if fresh else base


def _checks(rows: DataFrame, side: str) -> DataFrame:
    """What tells two states of a contract on a date apart: rows and sums of halves of their hashes.

    The stored state's hashes count against the new ones, so that equal states leave zero and
    a contract takes four numbers, not six, in the aggregate and in its shuffle.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = F.xxhash64(*SNAPSHOT.fieldNames())
    halves = (whole.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(whole, 32))
    low, high = halves if side == "new" else (-half for half in halves)
    counts = (none, one) if side == "new" else (one, none)
    sides = dict(zip(("n_old", "n_new", "low", "high"), (*counts, low, high), strict=True))
    return rows.select("criteria_date", "doc_id", *[v.alias(name) for name, v in sides.items()])


def _compared(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Per contract and date how many rows it has now, and change: added, removed, changed or NULL.

    Both states are added up side by side in one aggregate, where a contract
    without a document id meets itself too and hot keys shrink before the shuffle.
    """
    sides = _checks(stored, "old").unionByName(_checks(rows, "new"))
    names = [c for c in sides.columns if c not in ("criteria_date", "doc_id")]
    sums = sides.groupBy("criteria_date", "doc_id").agg(*[F.sum(n).alias(n) for n in names])
    same = (F.col("n_old") == F.col("n_new")) & (F.col("low") == 0) & (F.col("high") == 0)
    change = (
        F.when(F.col("n_old") == 0, "added")
        .when(F.col("n_new") == 0, "removed")
        .when(~same, "changed")
    )
    return sums.select("criteria_date", "doc_id", "n_new", change.alias("change"))


def snapshot_changes(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The contracts and dates in which rows differ from the stored snapshot, and how.

    change is added, removed or changed; a contract's rows of one date count as
    a whole, in any order, repeated rows with their number.
    """
    differing = _compared(stored, rows).where(F.col("change").isNotNull())
    return differing.select("criteria_date", "doc_id", "change")


class SnapshotSync(NamedTuple):
    """What a sync did: the version it left, and the dates it wrote and removed."""

    version: Version
    written: list[datetime.date]
    removed: list[datetime.date]


def sync_snapshot(rows: DataFrame, path: str) -> SnapshotSync:
    """Make the stored snapshot hold exactly rows, writing only the dates that differ.

    Dates without rows are gone afterwards. All of it is one commit; without a
    difference nothing is written and the version stays.
    """
    store = VersionedFolder(rows.sparkSession, path)
    base = store.current()
    kept = settle(rows).rows
    dates = settle(
        _compared(store.read(SNAPSHOT, version=base), kept)
        .groupBy("criteria_date")
        .agg(F.sum("n_new").alias("n"), F.count("change").alias("changes"))
        .where("changes > 0")
    ).rows
    found = dates.collect()  # a row for each calendar day at most
    written = sorted(r.criteria_date for r in found if r.n)
    removed = sorted(r.criteria_date for r in found if not r.n)
    if not found:
        return SnapshotSync(base, [], [])
    gone = {f"criteria_date={day}" for day in removed}
    parts = {part: folder for part, folder in base.parts.items() if part not in gone}
    if written:
        chosen = F.broadcast(dates.where("n > 0").select("criteria_date"))
        fresh = kept.join(chosen, "criteria_date", "left_semi").select(*SNAPSHOT.fieldNames())
        parts |= store.add(base, _dates_rows(fresh), "criteria_date")
    return SnapshotSync(store.commit(base, parts), written, removed)


def read_snapshot(
    spark: SparkSession, path: str, date: datetime.date | str | None = None
) -> DataFrame:
    """The newest version of the stored snapshot; of one date only, with nothing else listed."""
    part = None if date is None else f"criteria_date={parse_date(date)}"
    wanted = None if part is None else (lambda name: name == part)
    return VersionedFolder(spark, path).read(SNAPSHOT, wanted)


def snapshot_by_date(snapshot: DataFrame, date: datetime.date | str) -> DataFrame:
    """The stored rows of one criteria date in document order; reads that partition only."""
    return (
        snapshot.where(F.col("criteria_date") == F.lit(parse_date(date)))
        .select(*LOOKUP_COLUMNS)
        .orderBy(F.col("doc_id").asc_nulls_last())
    )
