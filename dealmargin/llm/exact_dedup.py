"""Exact dedup by content sort: equal texts end up next to each other.

Splitters sampled from the data cut the rows into ranges, each task sorts its
range, spilling where it must, and compares every text in full with the one
before it. What the splitters and the sort look at first is bounded: the
leading characters of the text, its hash, and a hash of the row's identifier.
The last one lets a group of copies of any size be cut over several tasks;
runs that touch the edge of a range are put together by comparing the texts of
the edges, of which every task has two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm.columns import text_or_empty
from dealmargin.operators.joins import settle

# Characters of a text that a splitter may carry to the driver.
LEAD = 32
# Places within a range are counted in this many bits, ranges in the rest.
_PLACE_BITS = 40


class _Run(NamedTuple):
    """Equal neighbours in the order in which the first is the one that stays."""

    text: str
    ids: list[pa.Array]
    place: int  # of its first row

    @property
    def size(self) -> int:
        return sum(map(len, self.ids))


def _starts(texts: pa.Array, before: str | None) -> np.ndarray:
    """Where a text differs from the one before it, all of both compared."""
    changes = np.ones(len(texts), dtype=bool)
    if len(texts) > 1:
        same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1))
        changes[1:] = ~same.to_numpy(zero_copy_only=False)
    if before is not None:
        changes[0] = not pc.equal(texts[0], pa.scalar(before, texts.type)).as_py()
    return np.flatnonzero(changes)


def _sha256(text: bytes | pa.Buffer) -> str:
    return hashlib.sha256(text).hexdigest()


_NAMES = ("_id", "_place", "_keep", "_keep_place", "_size", "_sha", "_edge", "_text")
_TYPES = "long long long long long string string string".split()


def _inner(texts: pa.Array, ids: pa.Array, starts: np.ndarray, place: int) -> pa.RecordBatch:
    """The rows of whole runs, which begin at starts."""
    sizes = np.diff(np.append(starts, len(ids)))
    run = np.repeat(np.arange(len(starts)), sizes)
    shas = pa.array([_sha256(t.as_buffer()) for t in texts.take(pa.array(starts))], pa.string())
    none = pa.nulls(len(ids), pa.string())
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(place + np.arange(len(ids))),
            ids.take(pa.array(starts[run])),
            pa.array(place + starts[run]),
            pa.array(sizes[run]),
            shas.take(pa.array(run)),
            none,
            none,
        ],
        names=_NAMES,
    )


def _whole(run: _Run, edge: str | None) -> Iterator[pa.RecordBatch]:
    """The rows of a run; at an edge of the task's range one more that carries its text."""
    sha, place, size = _sha256(run.text.encode("utf-8", "surrogatepass")), run.place, run.size

    def batch(ids: pa.Array, places: np.ndarray, text: str | None) -> pa.RecordBatch:
        same = (
            pa.scalar(run.ids[0][0].as_py(), pa.int64()),
            pa.scalar(run.place, pa.int64()),
            pa.scalar(size, pa.int64()),
            *(pa.scalar(value, pa.string()) for value in (sha, edge, text)),
        )
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(places), *[pa.repeat(value, len(ids)) for value in same]], names=_NAMES
        )

    for ids in run.ids:
        yield batch(ids, np.arange(place, place + len(ids)), None)
        place += len(ids)
    if edge is not None:
        yield batch(pa.nulls(1, pa.int64()), np.array([-1]), run.text)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each of a task's sorted rows, a text and an identifier, shares with its neighbours."""
    part = TaskContext.get().partitionId()
    place = part << _PLACE_BITS
    run: _Run | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, ids = batch.column(0), batch.column(1)
        starts = _starts(texts, None if run is None else run.text)
        rest = int(starts[0]) if len(starts) else len(ids)
        if rest:
            run.ids.append(ids.slice(0, rest))
        if len(starts):
            if run is not None:
                yield from _whole(run, f"{part}:first" if first else None)
                first = False
            inner, last = starts[:-1], int(starts[-1])
            if first and len(inner):
                end = int(starts[1])
                only = _Run(texts[rest].as_py(), [ids.slice(rest, end - rest)], place + rest)
                yield from _whole(only, f"{part}:first")
                first, inner, rest = False, inner[1:], end
            if len(inner):
                count = last - rest
                yield _inner(
                    texts.slice(rest, count), ids.slice(rest, count), inner - rest, place + rest
                )
            run = _Run(texts[last].as_py(), [ids.slice(last)], place + last)
        place += len(ids)
    if run is not None:
        yield from _whole(run, f"{part}:last")


def content_sorted(docs: DataFrame, id_column: str, text: Column, largest: bool) -> DataFrame:
    """_text and _id range-partitioned by sampled splitters and sorted, equals side by side.

    Of a task's equal texts the one to stay comes first.
    """
    own = F.col("_id")
    order = own.desc_nulls_last() if largest else own.asc_nulls_last()
    lead = F.left("_text", F.lit(LEAD))
    keys = [lead.alias("_lead"), F.xxhash64("_text").alias("_hash")]
    rows = docs.select(
        text_or_empty(text).alias("_text"), F.col(id_column).cast("long").alias("_id")
    ).select("_text", "_id", *keys)
    return (
        rows.repartitionByRange("_lead", "_hash", F.xxhash64("_id"))
        .sortWithinPartitions("_lead", "_hash", "_text", order)
        .select("_text", "_id")
    )


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after normalise, or as they are
    without it; NULL counts as empty. Of equal texts the row with the smallest
    identifier stays, or the largest with keep="largest"; keep_id names it,
    group_size counts the group's rows, and kept is true for that row alone.
    Where rows repeat an identifier and a text, one of them stays. A NULL
    identifier stays only where its group has no other, keep_id then being
    NULL. Identifiers are whole numbers. text_sha256 is of the normalised text
    in UTF-8. No rows give no rows, and other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = F.col(text_column) if normalise is None else normalise(text_or_empty(F.col(text_column)))
    largest = keep == "largest"
    found = settle(
        content_sorted(docs, id_column, text, largest).mapInArrow(
            neighbours, ", ".join(f"{n} {t}" for n, t in zip(_NAMES, _TYPES, strict=True))
        )
    ).rows
    edges = found.where(F.col("_text").isNotNull())
    rank = F.col("_keep") if largest else -F.col("_keep")
    whole = edges.groupBy("_text").agg(
        F.sum("_size").alias("_whole"),
        F.max(F.struct(rank.alias("rank"), F.col("_keep").alias("id"), "_keep_place")).alias("_best"),
    )
    # At most two rows for each task of the sort, without their texts.
    merged = edges.join(whole, "_text").select(
        "_edge", "_whole", F.col("_best.id").alias("_best_id"),
        F.col("_best._keep_place").alias("_best_place"),
    )
    rows = found.where(F.col("_text").isNull()).join(F.broadcast(merged), "_edge", "left")
    at_edge = F.col("_whole").isNotNull()
    place = F.when(at_edge, F.col("_best_place")).otherwise(F.col("_keep_place"))
    return rows.select(
        F.col("_id").alias(id_column),
        F.when(at_edge, F.col("_best_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_whole", "_size").alias("group_size"),
        (F.col("_place") == place).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
