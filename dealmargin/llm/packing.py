"""Packing: documents as token pieces in sequences, by dot-product vector bin packing.

Each task tokenises its rows and packs them itself, so nothing is shuffled and
no group is gathered: what a task holds at a time is one Arrow batch and at
most ROUND pieces waiting for a sequence.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END = 0
ROUND = 8192
CACHED_CHUNKS = 300_000
FULL = 0.98
# Fixed values of the public vocabulary: its pattern and its one special token.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPECIAL = {"<|endoftext|>": 50256}


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1023


class Tokenizer:
    """Ids of the byte-level vocabulary in a ranks file, as little-endian unsigned 32-bit bytes.

    A single space between two characters that are no white space always starts
    a new word of the pattern, so text is cut there and the pieces are cached.
    The cache is bounded; texts with other white space beside a space, or with
    the special token, are encoded whole.
    """

    def __init__(self, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(w): int(i) for w, i in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self._chunks: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return array("I", self._encoding.encode_ordinary(text)).tobytes()

    def _remember(self, chunks: set[str]) -> bool:
        """Cache what is new of these; false if one has white space at an end."""
        new = chunks.difference(self._chunks)
        if any(not c or c[0].isspace() or c[-1].isspace() for c in new):
            return False
        if len(self._chunks) + len(new) > CACHED_CHUNKS:
            self._chunks.clear()
            new = chunks
        for chunk in new:
            self._chunks[chunk] = self._bytes(" " + chunk)
        return True

    def encode(self, text: str) -> bytes:
        if any(s in text for s in SPECIAL):
            ids = self._encoding.encode(text, allowed_special="all")
            return array("I", ids).tobytes()
        first, *inner = text.split(" ")
        if not inner or not first or first[-1].isspace():
            return self._bytes(text)
        last = inner.pop()
        if not last or last[0].isspace() or not self._remember(set(inner)):
            return self._bytes(text)
        cached = map(self._chunks.__getitem__, inner)
        return self._bytes(first) + b"".join(cached) + self._bytes(" " + last)


@cache
def tokenizer(ranks_path: str) -> Tokenizer:
    """One tokenizer for each Python worker."""
    return Tokenizer(ranks_path)


@dataclass(frozen=True)
class Piece:
    """A run of one document's ids: where it starts, its ids, and where its loss begins."""

    own: object
    start: int
    ids: bytes
    of: int
    loss_from: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        """Loss-bearing tokens: those from loss_from on, but never a piece's first."""
        return max(0, self.start + self.tokens - max(self.loss_from, self.start + 1))

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return (
            replace(self, ids=self.ids[: 4 * tokens]),
            replace(self, start=self.start + tokens, ids=self.ids[4 * tokens :]),
        )


def dot_product_bins(pieces: list[Piece], limits: Limits) -> list[list[Piece]]:
    """Bins under all three limits; each takes the fitting piece most in line with its free space.

    The measure is the dot product of a piece's needs and the bin's free space,
    each as shares of the limits. Pieces with equal needs are one class, so a
    step costs the number of classes. Every piece must fit an empty bin.
    """
    classes: dict[tuple[int, int], list[Piece]] = {}
    for piece in pieces:
        classes.setdefault((piece.tokens, piece.loss), []).append(piece)
    keys = sorted(classes, reverse=True)
    stacks = [classes[k] for k in keys]
    most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    needs = np.array([(t, 1, loss) for t, loss in keys], dtype=np.int64).reshape(-1, 3)
    shares = needs / np.maximum(most, 1)
    left = np.array([len(s) for s in stacks])
    whole = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64)
    bins: list[list[Piece]] = []
    free, current = whole.copy(), []
    for _ in range(len(pieces)):
        while True:
            fits = (left > 0) & (needs <= free).all(axis=1)
            if fits.any():
                break
            bins.append(current)
            free, current = whole.copy(), []
        at = int(np.where(fits, shares @ (free / np.maximum(most, 1)), -1.0).argmax())
        current.append(stacks[at].pop())
        left[at] -= 1
        free = free - needs[at]
    if current:
        bins.append(current)
    return bins


def cut_into_bins(pieces: list[Piece], limits: Limits) -> list[list[Piece]]:
    """Bins filled in order, each piece cut where its bin is full; only the last stays short."""
    bins: list[list[Piece]] = []
    current: list[Piece] = []
    waiting = pieces[::-1]
    while waiting:
        piece = waiting.pop()
        tokens = limits.tokens - sum(p.tokens for p in current)
        loss = limits.loss - sum(p.loss for p in current)
        before_loss = max(0, max(piece.loss_from, piece.start + 1) - piece.start)
        room = min(tokens, before_loss + loss, piece.tokens)
        if len(current) == limits.segments or room <= 0:
            bins.append(current)
            current = []
            waiting.append(piece)
            continue
        head, tail = piece.cut(room)
        current.append(head)
        if tail.tokens:
            waiting.append(tail)
    if current:
        bins.append(current)
    return bins


class _Packer:
    """Sequences of one task, numbered from its partition's own range."""

    def __init__(self, limits: Limits, partition: int):
        self.limits = limits
        self.next_sequence = partition << 40
        self.waiting: list[Piece] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p.own, p.start, p.tokens, p.ids, p.of, self.next_sequence, at))
            at += p.tokens
        self.next_sequence += 1

    def add(self, own: object, ids: bytes, loss_from: int) -> None:
        """Emit the pieces that fill a sequence alone; keep the rest of the document waiting."""
        of = len(ids) // 4
        rest = Piece(own, 0, ids, of, loss_from)
        whole = min(self.limits.tokens, self.limits.loss)
        while rest.tokens >= self.limits.tokens:
            # A piece that is loss-bearing all through is cut at the loss limit as well.
            head, rest = rest.cut(self.limits.tokens)
            if head.loss > self.limits.loss:
                head, more = head.cut(whole)
                self.waiting.append(more)
            self._emit([head])
        if rest.loss > self.limits.loss:
            head, rest = rest.cut(whole)
            self.waiting.append(head)
        if rest.tokens:
            self.waiting.append(rest)
        if len(self.waiting) >= ROUND:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        """Pack what waits; poorly filled bins wait for the next round, or are cut to fill."""
        poor: list[Piece] = []
        for pieces in dot_product_bins(self.waiting, self.limits):
            if sum(p.tokens for p in pieces) >= FULL * self.limits.tokens:
                self._emit(pieces)
            else:
                poor += pieces
        self.waiting = poor
        if last or len(poor) > ROUND // 2:
            for pieces in cut_into_bins(poor, self.limits):
                self._emit(pieces)
            self.waiting = []

    def taken(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = list(zip(*self.rows, strict=True))
            self.rows = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    loss_from_column: str | None = None,
) -> DataFrame:
    """Pieces of all documents, each in one sequence within the limits.

    A document is its text's ids and the id END. Columns: the id, start (its
    ids before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset in the sequence, which runs from 0 without gaps.
    loss_from_column counts the ids at a document's start that bear no loss,
    such as a prompt's; without it, or where NULL, all bear loss but each
    piece's first, which nothing precedes.

    NULL text is empty and gives the one id END. Repeated rows are packed each
    for itself, a NULL id stays NULL. No rows give no rows. Other columns are
    not carried; they are met again on the id. Sequence ids are unique but not
    gapless: the partition in the high bits, a counter in the low 40.
    """
    arrow = pa.schema(
        [
            ("own", _arrow_type(docs.schema[id_column].dataType)),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(ranks_path)
        end = array("I", [END]).tobytes()
        packer = _Packer(limits, TaskContext.get().partitionId())
        for batch in batches:
            loss_from = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
            for own, text, prompt in zip(batch.column(0), batch.column(1), loss_from, strict=True):
                prompt = prompt if prompt is None else prompt.as_py()
                packer.add(own.as_py(), known.encode(text.as_py() or "") + end, prompt or 0)
            yield from packer.taken(arrow)
        packer.pack(last=True)
        yield from packer.taken(arrow)

    columns = [id_column, text_column] + ([loss_from_column] if loss_from_column else [])
    schema = T.StructType(
        [T.StructField(id_column, docs.schema[id_column].dataType)]
        + [
            T.StructField(f.name, T.BinaryType() if f.name == "ids" else T.LongType())
            for f in list(arrow)[1:]
        ]
    )
    arrow = pa.schema([pa.field(id_column, arrow.field(0).type), *list(arrow)[1:]])
    return docs.select(*columns).mapInArrow(each, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
