"""Conversation prefix trie: which beginnings conversations share, and what sharing them saves.

A node is a distinct sequence of the first d turns. Nearly all nodes belong to
one conversation only, so a count-min sketch of the prefix digests is asked
first: a count of one proves that a prefix, and with it every longer one of
that conversation, is no one else's, and these tails become rows where they
are. Only prefixes that may be shared are shuffled and grouped exactly.

Sums over subtrees need no walk through the tree: each node is given to its
smallest member, a member's nodes are added up from its deepest to each of its
prefixes, and these sums are grouped by prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealmargin.operators.joins import settle, spread_join

DIGEST_BYTES = 16
# The sketch: rows of counters, so many counters a prefix, and at most so many in a row. What
# tasks get is a bit a counter, 2^28 bits or 32 MB a row; beyond some 10^8 prefixes ever more
# of them are grouped exactly without need, and the result stays the same.
SKETCH_ROWS = 2
COUNTERS_PER_PREFIX = 8
MAX_COUNTERS = 1 << 28
_BLOCK = 1 << 16
# Buckets a task holds before it hands them on, and identifiers in one piece of a list of ends.
HELD_BUCKETS = 1 << 21
PIECE_IDS = 1 << 16

_NEXT_END, _NEXT_SHARED, _NEXT_TAIL, _NEXT_TAIL_END = range(4)
ROOT = bytes(DIGEST_BYTES)


# --- prefixes ----------------------------------------------------------------------


class _Prefix(NamedTuple):
    """A node as one of its members sees it."""

    digest: bytes
    chars: int


def extended(before: bytes, role: str, text: str) -> bytes:
    """The digest of a sequence of turns and one more."""
    own = role.encode("utf-8", "surrogatepass")
    body = text.encode("utf-8", "surrogatepass")
    parts = (before, len(own).to_bytes(8, "little"), own, body)
    return hashlib.blake2b(b"".join(parts), digest_size=DIGEST_BYTES).digest()


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest, chars, last = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(conv, pa.int64()),
            pa.array(depth, pa.int64()),
            pa.array(digest, pa.binary()),
            pa.array(chars, pa.int64()),
            pa.array(last, pa.bool_()),
        ],
        names=["_conv", "_depth", "_digest", "_chars", "_last"],
    )


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of the conversations of sorted rows, the root first and the whole one last.

    Rows hold a group, a conversation, how many turns it takes over from the
    group's head, a role and a text. The head comes first in its group; of it no
    more than its leading prefixes are remembered.
    """
    group = conv = None
    taken = own = depth = 0
    head: list[_Prefix] = []  # the head's leading prefixes, from the first turn on
    at = _Prefix(ROOT, 0)
    out: list[tuple] = []

    def add(prefix: _Prefix) -> None:
        nonlocal at, depth
        out.append((conv, depth, at.digest, at.chars, False))
        at, depth = prefix, depth + 1

    for batch in batches:
        for base, c, h, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if conv is None or c != conv:
                if conv is not None:
                    out.append((conv, depth, at.digest, at.chars, True))
                if base != group:
                    group, head = base, []
                conv, taken, own, depth, at = c, h, 0, 0, _Prefix(ROOT, 0)
                if conv != group:
                    for prefix in head[:taken]:
                        add(prefix)
            own += 1
            if conv == group or own > taken:
                add(_Prefix(extended(at.digest, role, text), len(text)))
                if conv == group and len(head) < _HEAD_TURNS:
                    head.append(at)
        if out:
            yield _prefix_batch(out)
            out = []
    if conv is not None:
        yield _prefix_batch([(conv, depth, at.digest, at.chars, True)])


_HEAD_TURNS = 5


def prefixes(
    conversations: DataFrame,
    taken: Column | None = None,
    head: Column | None = None,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Each conversation's prefixes, as _conv, _depth, _digest, _chars of the last text and _last.

    Turns are ordered by number, NULL first, and then by role and text; NULL
    roles and texts are empty, rows without a conversation are left out. With
    head and taken, columns of the conversation's identifier, a conversation
    begins with the first taken turns (at most 5) of the conversation head
    instead of its own first ones. One shuffle brings a head and those that
    take from it together; a task holds one turn at a time.
    """
    conv = F.col(conv_column).cast("long")
    rows = conversations.where(F.col(conv_column).isNotNull()).select(
        F.coalesce(conv if head is None else head, conv).alias("_head"),
        conv.alias("_conv"),
        (F.lit(0) if taken is None else F.least(taken, F.lit(_HEAD_TURNS))).cast("int").alias("_taken"),
        F.col(turn_column).alias("_turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    )
    ordered = rows.repartition("_head").sortWithinPartitions(
        "_head", F.col("_conv") != F.col("_head"), "_conv",
        F.col("_turn").asc_nulls_first(), "_role", "_text",
    )
    return ordered.select("_head", "_conv", "_taken", "_role", "_text").mapInArrow(
        _chains, "_conv long, _depth long, _digest binary, _chars long, _last boolean"
    )


# --- the sketch --------------------------------------------------------------------


def counters_for(prefix_count: int) -> int:
    """A power of two of counters in each row of the sketch."""
    wanted = max(_BLOCK, COUNTERS_PER_PREFIX * prefix_count)
    return min(MAX_COUNTERS, 1 << (wanted - 1).bit_length())


def _buckets(digests: pa.Array, counters: int) -> np.ndarray:
    """The counter of each digest in each row: its halves are hashes of their own."""
    whole = b"".join(digests.to_pylist())
    halves = np.frombuffer(whole, dtype="<u8").reshape(-1, SKETCH_ROWS)
    return (halves & np.uint64(counters - 1)).T


def _local_sketch(buckets: list[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    """The touched counters of each block of so many: those of one, and those of more."""
    held = np.concatenate(buckets, axis=1)
    for row in range(SKETCH_ROWS):
        touched, n = np.unique(held[row], return_counts=True)
        blocks = (touched // np.uint64(block)).astype(np.int64)
        places = (touched % np.uint64(block)).astype("<u2")
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]
        once, more = [], []
        for a, b in zip(starts, ends, strict=True):
            one = n[a:b] == 1
            once.append(places[a:b][one].tobytes())
            more.append(places[a:b][~one].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row] * len(starts), pa.int32()),
                pa.array(blocks[starts]),
                pa.array(once, pa.binary()),
                pa.array(more, pa.binary()),
            ],
            names=["_row", "_block", "_once", "_more"],
        )


def _merged_blocks(
    batches: Iterator[pa.RecordBatch], block: int
) -> Iterator[pa.RecordBatch]:
    """From sorted parts of blocks a bit for each counter of two or more."""
    key, counts = None, np.zeros(block, dtype=np.int64)

    def merged() -> pa.RecordBatch:
        bits = np.packbits(counts > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([bits])],
            names=["_row", "_block", "_bits"],
        )

    for batch in batches:
        for row, at, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row, at) != key:
                if key is not None and (counts > 1).any():
                    yield merged()
                key, counts = (row, at), np.zeros(block, dtype=np.int64)
            counts[np.frombuffer(once, dtype="<u2")] += 1
            counts[np.frombuffer(more, dtype="<u2")] += 2
    if key is not None and (counts > 1).any():
        yield merged()


def shared_bits(kept_prefixes: DataFrame, counters: int) -> np.ndarray:
    """The sketch as bits: for each row and counter whether it counts two or more.

    Every task counts its own digests and hands on the counters it touched, two
    bytes each; counts of the same block are added up by one task as they pass.
    """
    block = min(_BLOCK, counters)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(_buckets(batch.column(0), counters))
                size += batch.num_rows
            if size >= HELD_BUCKETS:
                yield from _local_sketch(held, block)
                held, size = [], 0
        if held:
            yield from _local_sketch(held, block)

    parts = kept_prefixes.select("_digest").mapInArrow(
        each, "_row int, _block long, _once binary, _more binary"
    )
    blocks = (
        parts.repartition("_row", "_block")
        .sortWithinPartitions("_row", "_block")
        .mapInArrow(partial(_merged_blocks, block=block), "_row int, _block long, _bits binary")
        .toArrow()
    )
    bits = np.zeros((SKETCH_ROWS, counters // 8), dtype=np.uint8)
    size = block // 8
    for row, at, part in zip(*(c.to_pylist() for c in blocks.columns), strict=True):
        bits[row, at * size : (at + 1) * size] = np.frombuffer(part, dtype=np.uint8)
    return bits


def _may_be_shared(digests: pa.Array, bits: np.ndarray) -> np.ndarray:
    """False only where the sketch estimates one."""
    out = np.ones(len(digests), dtype=bool)
    for row, at in enumerate(_buckets(digests, bits.shape[1] * 8)):
        out &= (bits[row, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 1
    return out


def screened(kept_prefixes: DataFrame, sketch: Broadcast) -> DataFrame:
    """The prefixes with _shared, whether others may have them, and _next, what follows.

    A conversation's prefixes stand next to each other, the root first; once one
    is proven to be its own, all longer ones are. _top marks the first of these.
    """

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        held: pa.RecordBatch | None = None  # the last row, whose next one is not seen yet
        proven = False
        for batch in batches:
            if not batch.num_rows:
                continue
            before = proven
            maybe = _may_be_shared(batch.column(2), bits)
            starts = batch.column(1).to_numpy() == 0
            shared = np.empty(len(maybe), dtype=bool)
            for i, (open_, start) in enumerate(zip(maybe.tolist(), starts.tolist(), strict=True)):
                proven = (proven and not start) or not (open_ or start)
                shared[i] = not proven
            top = ~shared & np.concatenate([[not before], shared[:-1]])
            rows = batch.append_column("_shared", pa.array(shared))
            rows = rows.append_column("_top", pa.array(top))
            if held is not None:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
            held = rows.slice(len(rows) - 1)
            if len(rows) > 1:
                yield _with_next(rows.slice(0, len(rows) - 1), rows.slice(1))
        if held is not None:
            yield _with_next(held, held)

    return kept_prefixes.mapInArrow(
        flagged,
        "_conv long, _depth long, _digest binary, _chars long, _last boolean, _shared boolean, "
        "_top boolean, _next int",
    )


def _with_next(rows: pa.RecordBatch, following: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with what comes after each, if it is not its conversation's last."""
    last = rows.column(4).to_numpy(zero_copy_only=False)
    shared = following.column(5).to_numpy(zero_copy_only=False)
    ends = following.column(4).to_numpy(zero_copy_only=False)
    after = np.where(shared, _NEXT_SHARED, np.where(ends, _NEXT_TAIL_END, _NEXT_TAIL))
    return rows.append_column("_next", pa.array(np.where(last, _NEXT_END, after).astype(np.int32)))


# --- the trie ----------------------------------------------------------------------


def _joined_ids(
    batches: Iterator[pa.RecordBatch], piece_ids: int
) -> Iterator[pa.RecordBatch]:
    """Sorted nodes and members as pieces of joined members, each with its first."""
    node, ids = None, []
    for batch in batches:
        out = []
        for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (digest != node or len(ids) >= piece_ids):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = digest
            ids.append(conv)
        if out:
            yield _piece_batch(out)
    if ids:
        yield _piece_batch([(node, ids[0], ",".join(map(str, ids)))])


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    digest, first, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(digest, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())],
        names=["_digest", "_first", "_ids"],
    )


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces in order, joined by commas."""
    node, state = None, None
    for batch in batches:
        done = []
        for digest, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield _list_batch(done)
    if state is not None:
        yield _list_batch([(node, state.hexdigest())])


def _list_batch(rows: list[tuple]) -> pa.RecordBatch:
    digest, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(digest, pa.binary()), pa.array(sha, pa.string())], names=["_digest", "_sha"]
    )


def listed_ends(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """_sha of each _digest: the hash of its members' identifiers, ascending and comma-joined.

    A node with very many members is sorted in several tasks, which join them
    into pieces; the one task that hashes a node reads its few pieces in turn.
    """
    pieces = (
        ends.repartitionByRange("_digest", "_conv")
        .sortWithinPartitions("_digest", "_conv")
        .mapInArrow(
            partial(_joined_ids, piece_ids=piece_ids), "_digest binary, _first long, _ids string"
        )
    )
    return (
        pieces.repartition("_digest")
        .sortWithinPartitions("_digest", "_first")
        .mapInArrow(_hashed_lists, "_digest binary, _sha string")
    )


def _own(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _saved(counted: Column) -> Column:
    return F.when(counted, (F.col("_n") - 1) * F.col("_chars")).otherwise(F.lit(0))


def shared_nodes(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of prefixes that may be shared, and the first nodes of the tails under them."""
    groups = shared.groupBy("_digest").agg(
        F.min("_conv").alias("_rep"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_last").alias("_ends"),
    )
    met = settle(spread_join(shared, groups, ["_digest"], "inner")).rows
    up = Window.partitionBy("_conv").orderBy(F.col("_depth").desc())
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("_rep") == F.col("_conv")
    goes_on_alone = F.col("_next").isin(_NEXT_TAIL, _NEXT_TAIL_END)
    leaf = goes_on_alone | ((F.col("_next") == _NEXT_END) & (F.col("_ends") == F.col("_n")) & first)
    below = F.lag("_rep").over(up) == F.col("_conv")
    summed = met.select(
        "*",
        F.lead("_rep").over(up).alias("_parent"),
        # only the deepest of a conversation's shared prefixes can tell whether it ends in a leaf
        F.max(_own(leaf & (F.col("_next") != _NEXT_SHARED))).over(so_far).alias("_leaf"),
        F.sum(_saved(first)).over(so_far).alias("_saved"),
        _own(goes_on_alone | ((F.col("_next") == _NEXT_SHARED) & below)).alias("_child"),
    )
    single = F.when(F.col("_ends") == 1, F.when(F.col("_last"), F.col("_conv")))
    nodes = summed.groupBy("_digest").agg(
        F.min("_rep").alias("conv_id"),
        F.min("_depth").alias("depth"),
        F.min("_parent").alias("parent_conv_id"),
        F.min("_n").alias("n_convs"),
        F.sum("_child").alias("n_children"),
        F.sum("_leaf").alias("n_leaves"),
        F.sum("_saved").alias("saved_tokens"),
        F.min("_ends").alias("_ends"),
        F.max(single).alias("_end"),
    )
    many = met.where((F.col("_ends") > 1) & F.col("_last")).select("_digest", "_conv")
    listed = nodes.join(listed_ends(many), "_digest", "left")
    ids = F.coalesce(F.col("_end").cast("string"), F.lit(""))
    nodes = listed.select(*_NODE[:-1], F.coalesce("_sha", F.sha2(ids, 256)).alias("ends_sha256"))
    tops = met.where(goes_on_alone).select(
        F.col("_conv").alias("_conv"),
        (F.col("_depth") + 1).alias("_depth"),
        F.col("_rep").alias("_above"),
        (F.col("_next") == _NEXT_TAIL_END).alias("_last"),
    )
    return nodes, _alone(tops)


_NODE = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def _alone(tails: DataFrame) -> DataFrame:
    """Nodes that only one conversation has."""
    ids = F.when(F.col("_last"), F.col("_conv").cast("string")).otherwise("")
    return tails.select(
        F.col("_conv").alias("conv_id"),
        F.col("_depth").alias("depth"),
        F.col("_above").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        _own(~F.col("_last")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(ids, 256).alias("ends_sha256"),
    )


def prefix_trie(prefix_rows: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """One row per distinct prefix of the conversations that prefixes() gave, the root included.

    conv_id is the smallest member and parent_conv_id the parent's (NULL for the
    root); n_convs counts the conversations that begin so, n_children the nodes
    one turn longer and n_leaves the childless ones in the subtree, the node
    itself included. saved_tokens adds up, over the subtree, the code points of
    each node's last text times its members but one. ends_sha256 is the SHA-256
    of the members that end here, in ascending order, comma-joined. A
    conversation without turns is a member of the root alone; conversations of
    equal turns end at one node; no conversations give no rows.
    """
    kept = settle(prefix_rows)
    counters = min(max_counters, counters_for(kept.count))
    spark = prefix_rows.sparkSession
    sketch = spark.sparkContext.broadcast(shared_bits(kept.rows, counters))
    found = settle(screened(kept.rows, sketch)).rows
    sketch.destroy()
    nodes, tops = shared_nodes(found.where("_shared").drop("_shared"))
    # Of a tail all but its top hang on the same conversation's node above.
    rest = found.where(~F.col("_shared") & ~F.col("_top")).withColumn("_above", F.col("_conv"))
    return nodes.unionByName(tops).unionByName(_alone(rest))
