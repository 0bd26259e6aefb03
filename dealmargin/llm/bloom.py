"""A blocked Bloom filter as a table of blocks.

Each block has eight 64-bit words; a value sets one bit in each word of its
block. The table is built by a bit-wise OR per block and broadcast: MAX_BLOCKS
rows of nine longs, some 30 MB, however many values there are. More values fill
the blocks and let more through; what passes is always met by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm.columns import enclosed
from dealmargin.operators.joins import settle

WORDS = 8
VALUES_PER_BLOCK = 40  # about 13 bits of the 512 for each value
MAX_BLOCKS = 1 << 18


def block_count(values: int) -> int:
    return min(MAX_BLOCKS, max(1, values // VALUES_PER_BLOCK))


def _block(value: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks))


def _masks(value: str) -> list[Column]:
    bits = F.xxhash64(F.lit(1), value)
    one = F.lit(1).cast("long")
    return [
        F.call_function(
            "shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")
        )
        for i in range(WORDS)
    ]


def bloom_filter(values: DataFrame, value: str, blocks: int) -> DataFrame:
    """The blocks that hold a value, as _block and the words _w0 to _w7."""
    words = {f"_w{i}": mask for i, mask in enumerate(_masks(value))}
    return (
        values.select(_block(value, blocks).alias("_block"), *[m.alias(w) for w, m in words.items()])
        .groupBy("_block")
        .agg(*[F.bit_or(w).alias(w) for w in words])
    )


def with_possible(
    rows: DataFrame, bloom: DataFrame, value: str, blocks: int, possible: str
) -> DataFrame:
    """Rows with a column that is false only where the value is surely not in the filter."""
    hit = F.lit(True)
    for i, mask in enumerate(_masks(value)):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    return (
        rows.withColumn("_block", _block(value, blocks))
        .join(F.broadcast(bloom), "_block", "left")
        .withColumn(possible, F.coalesce(hit, F.lit(False)))
        .drop("_block", *[f"_w{i}" for i in range(WORDS)])
    )


def without_rows(
    rows: DataFrame, lost: DataFrame, id_column: str, text_column: str, lost_id: str, lost_hash: str
) -> DataFrame:
    """Rows but those whose id and xxhash64 of the text are in lost; NULL ids equal each other.

    Rows that the filter of lost ones rules out stay where they are, so only the
    lost rows and a few others are shuffled, never the whole of the texts.
    """
    gone = settle(
        lost.select(F.col(lost_id).alias("_gone"), F.col(lost_hash).alias("_gone_hash")).distinct()
    )
    blocks = block_count(gone.count)
    key = F.xxhash64("_gone", "_gone_hash").alias("_pair")
    known = bloom_filter(gone.rows.select(key), "_pair", blocks)
    hashed = enclosed(rows, _id=F.col(id_column), _hash=F.xxhash64(F.col(text_column)))
    paired = hashed.withColumn("_pair", F.xxhash64("_id", "_hash"))
    probed = with_possible(paired, known, "_pair", blocks, "_maybe")
    stay = probed.where(~F.col("_maybe")).select("_own.*")
    rest = probed.where("_maybe").join(
        gone.rows,
        F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash")),
        "left_anti",
    )
    return stay.unionByName(rest.select("_own.*"))
