"""Join helpers for sides of measured size and for keys that may be hot or empty."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dealmargin.session import scratch_dir

# A broadcast side of this many narrow rows stays within some tens of MB.
BROADCAST_ROWS = 500_000
# Bytes of text that such a side may hold besides.
BROADCAST_TEXT = 32_000_000
_SPREAD = 1024


class Settled(NamedTuple):
    """Rows kept in the checkpoint folder, how many they are, and the bytes of their texts."""

    rows: DataFrame
    count: int
    text: int = 0

    @property
    def small(self) -> bool:
        return self.count <= BROADCAST_ROWS

    @property
    def few(self) -> bool:
        """Whether rows of some hundred bytes, one for each of these, may be broadcast too."""
        return self.count <= BROADCAST_ROWS // 5

    @property
    def light(self) -> bool:
        """Whether the rows may be broadcast with their texts."""
        return self.small and self.text <= BROADCAST_TEXT

    def hinted(self, *columns: str) -> DataFrame:
        """The rows, or some columns of them, with a broadcast hint if their count allows."""
        rows = self.rows.select(*columns) if columns else self.rows
        return F.broadcast(rows) if self.small else rows


def settle(rows: DataFrame) -> Settled:
    """Compute a selection once and count it and its texts' bytes on the way.

    For a selection that several joins need: the plan after it stays short, its
    facts are scanned once, and a lost executor costs no recomputation.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(rows.sparkSession))
    seen = Observation()
    texts = [f.name for f in rows.schema if isinstance(f.dataType, StringType)]
    lengths = [F.coalesce(F.octet_length(name), F.lit(0)).cast("long") for name in texts]
    kept = rows.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum(sum(lengths, F.lit(0).cast("long"))).alias("text"),
    ).checkpoint()
    return Settled(kept, seen.get["n"], seen.get["text"] or 0)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    row_id: Column | None = None,
) -> DataFrame:
    """Join whose left side may hold very many rows of one key, or of none.

    A key found on much of the left side is split by the adaptive skew join,
    but only where either side comes straight from a shuffle made for this
    join. A side aggregated, joined or united by the same key reuses that
    earlier shuffle and rules the split out. A further join column, equal on
    both sides, takes the earlier shuffle out of the question.

    With row_id, left rows whose last key is NULL are spread over the tasks by
    it. They match nothing, yet hashing would send all of them to one.
    """
    last = F.col(keys[-1])
    zero = F.xxhash64(last).bitwiseAND(F.lit(0))  # not a literal, which would be folded away
    spread = zero
    if row_id is not None:
        spread = F.when(last.isNull(), F.pmod(F.xxhash64(row_id), F.lit(_SPREAD))).otherwise(zero)
    return (
        left.withColumn("_spread", spread)
        .join(right.withColumn("_spread", zero), [*keys, "_spread"], how)
        .drop("_spread")
    )
