"""Sharding: proportional stratified interleaving into shards of equal row count.

Rows are shuffled by a seeded hash within their stratum and given the
fractional rank (2 r - 1) / (2 n) there. Sorted by it, every run of rows holds
the strata in the proportions of the whole, so equal cuts give equal mixtures.

Both ranks are taken in buckets of the sorting key: rows are numbered within a
bucket, and the counts of the buckets before it are added. No task sorts a
whole stratum, so a stratum holding most rows is split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealmargin.llm.columns import enclosed, without

ROWS_PER_BUCKET = 1000
MAX_BUCKETS = 16384
_KEY_BITS = 60


def seeded_key(seed: str, *values: Column) -> Column:
    """A 60-bit number from the MD5 of the seed and the values, the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("long")


def _ranked(
    rows: DataFrame, group: list[str], bucket: str, order: list[str], rank: str, total: str
) -> DataFrame:
    """Rows with their rank from 1 within a group, and the group's size.

    bucket must not decrease along the order within a group.
    """
    sizes = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group,
        bucket,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(total),
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(starts, [*group, bucket])
        .withColumn(rank, F.col("_before") + F.col("_row"))
        .drop("_row", "_before")
    )


def interleaved_shards(
    rows: DataFrame,
    shards: int,
    stratum_column: str = "source",
    id_column: str = "doc_id",
    seed: str = "shard",
) -> DataFrame:
    """Rows with shard and slot: every row in one shard, counts at most one apart.

    Slots run from 0 without gaps in each shard, in the interleaved order. NULL
    in the stratum column is a stratum of its own and a NULL id hashes like an
    empty one. Equal fractional ranks are ordered by stratum, hash and id; rows
    alike in all of them are interchangeable and get neighbouring slots. Columns
    called shard or slot are replaced, others pass through. No rows give no rows.
    """
    rows = without(rows, "shard", "slot")
    buckets = min(MAX_BUCKETS, max(1, rows.count() // ROWS_PER_BUCKET))
    stratum, own = F.col(stratum_column).cast("string"), F.col(id_column)
    keyed = enclosed(
        rows,
        _stratum=F.when(stratum.isNull(), "0").otherwise(F.concat(F.lit("1"), stratum)),
        _key=seeded_key(seed, own),
        _id=own,
    ).withColumn("_bucket", F.shiftright(F.shiftright("_key", _KEY_BITS - 20) * buckets, 20))
    order = ["_key", "_id"]
    within = _ranked(keyed, ["_stratum"], "_bucket", order, "_rank", "_of").drop("_bucket")
    fractional = within.withColumn(
        "_fraction", (2 * F.col("_rank") - 1).cast("double") / (2 * F.col("_of")).cast("double")
    ).withColumn("_part", F.floor(F.col("_fraction") * buckets))
    placed = _ranked(
        fractional, [], "_part", ["_fraction", "_stratum", *order], "_place", "_all"
    )
    shard = F.expr(f"((_place - 1) * {shards}) div _all")
    return (
        placed.withColumn("shard", shard)
        .withColumn(
            "slot",
            F.expr(f"_place - 1 - ((shard * _all + {shards - 1}) div {shards})"),
        )
        .select("_own.*", F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; within it, files follow the slots."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
