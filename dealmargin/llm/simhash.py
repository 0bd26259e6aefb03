"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius share a variant within half the radius of
each, so every fingerprint emits all its variants within half the radius and
equal variants meet in a shuffle. Members of such a ball are within the radius
of each other by construction, so linking each to the smallest member loses no
component and emits no pairs.

A ball of radius 2 around 64 bits has 2081 variants. Most fingerprints have no
partner at all, so a first round asks whether there can be one: of three blocks
of the bits, some two hold at most half of the differing bits, and the ball of
half that radius around those 43 bits has 44 variants. Where two fingerprints
or more meet, each is linked to the smallest if a comparison of all bits allows
it. Only these fingerprints enter the second round, over whole balls, which
looks for variants that two of the components found so far have in common.

In both rounds an aggregate finds the variants that matter, and a Bloom filter
of them keeps all other rows from a second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealmargin.llm import bloom
from dealmargin.llm.components import component_roots
from dealmargin.operators.joins import Settled, settle, spread_join

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
VARIANTS_PER_TASK = 2_000_000  # what a task's aggregate holds without spilling
_RUN = 1 << 16
_BYTE_BITS = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half its shingles' hashes have it set."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    size = min(size, len(words))
    total = len(words) - size + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, _RUN):
        n = min(_RUN, total - start)
        run = (xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, n))
        lanes = np.fromiter(run, dtype="<u8", count=n).view(np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every row's id, the hash of its text, and its fingerprint as a signed long, _fp."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())],
                names=["_id", "_hash", "_fp"],
            )

    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_column].dataType),
            T.StructField("_hash", T.LongType()),
            T.StructField("_fp", T.LongType()),
        ]
    )
    columns = [id_column, text_column, F.xxhash64(F.col(text_column))]
    return docs.select(*columns).mapInArrow(each, schema)


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _flips(positions: list[int], radius: int) -> list[int]:
    """Masks of at most radius of the given bits, the empty one included."""
    return [
        sum(1 << p for p in chosen)
        for size in range(radius + 1)
        for chosen in combinations(positions, size)
    ]


def ball_variants(fp: Column, radius: int) -> Column:
    """All 64-bit values within the radius."""
    flips = [F.lit(_signed(m)).cast("long") for m in _flips(list(range(BITS)), radius)]
    return F.transform(F.array(*flips), lambda m: fp.bitwiseXOR(m))


def block_variants(fp: Column, radius: int, parts: int = 3) -> Column:
    """For each way to leave out one of the blocks, the ball around the other bits.

    Of radius differing bits, the blocks left in hold at most
    radius * (parts - 1) // parts for some way; the ball has half of that. The
    block left out holds the number of the way.
    """
    edges = [BITS * i // parts for i in range(parts + 1)]
    inner = radius * (parts - 1) // parts
    masks = []
    for part in range(parts):
        kept = [b for b in range(BITS) if not edges[part] <= b < edges[part + 1]]
        whole = sum(1 << b for b in kept)
        for flip in _flips(kept, (inner + 1) // 2):
            masks.append(
                F.struct(
                    F.lit(_signed(whole)).cast("long").alias("kept"),
                    F.lit(_signed(flip | (part + 1) << edges[part])).cast("long").alias("flip"),
                )
            )
    return F.transform(
        F.array(*masks), lambda m: fp.bitwiseAND(m["kept"]).bitwiseXOR(m["flip"])
    )


def _met(balls: DataFrame, member: str) -> DataFrame:
    """Members of the keys that two or more emit, each with the smallest member of its key.

    One row per fingerprint and such a key: never a pair of members.
    """
    shared = settle(
        balls.groupBy("_key")
        .agg(F.min(member).alias("_least"), F.max(member).alias("_most"))
        .where(F.col("_least") < F.col("_most"))
        .select("_key", "_least")
    )
    blocks = bloom.block_count(shared.count)
    known = bloom.bloom_filter(shared.rows, "_key", blocks)
    possible = bloom.with_possible(balls, known, "_key", blocks, "_maybe").where("_maybe")
    return spread_join(possible.drop("_maybe"), shared.rows, ["_key"], "inner")


def _dealt(fps: Settled, variants: int) -> DataFrame:
    """Fingerprints over so many tasks that each makes at most about VARIANTS_PER_TASK rows."""
    tasks = -(-fps.count * variants // VARIANTS_PER_TASK)
    return fps.rows.repartition(max(1, tasks), "_fp")


def fingerprint_components(fps: Settled, radius: int = RADIUS) -> DataFrame:
    """The fingerprints of _fp that have one within the radius, as node, and their component, root.

    Fingerprints must be distinct. Those without a partner may be left out.
    """
    fp = F.col("_fp")
    dealt = _dealt(fps, 131)
    first = dealt.select("_fp", F.explode(block_variants(fp, radius)).alias("_key"))
    partnered = settle(
        _met(first, "_fp")
        .select("_fp", "_least", (F.bit_count(fp.bitwiseXOR(F.col("_least"))) <= radius).alias("_near"))
        .distinct()
    ).rows
    near = component_roots(partnered.where("_near"), "_fp", "_least")
    labelled = settle(
        partnered.select("_fp")
        .distinct()
        .join(near, fp == F.col("node"), "left")
        .select("_fp", F.coalesce("root", "_fp").alias("_label"))
    )
    balls = _dealt(labelled, 2081).select(
        "_label", F.explode(ball_variants(fp, (radius + 1) // 2)).alias("_key")
    )
    bridges = _met(balls, "_label").select("_label", "_least").distinct()
    joined = component_roots(bridges, "_label", "_least")
    return labelled.rows.join(joined, F.col("_label") == F.col("node"), "left").select(
        F.col("_fp").alias("node"), F.coalesce("root", "_label").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: its id, text_hash, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in at most radius bits are linked;
    component_id is the smallest id reachable over links. radius is even, so
    that both halves of a meeting are equal. NULL and wordless texts have
    fingerprint zero and link like any other; equal fingerprints, repeated rows
    among them, count once in every shuffle. Rows without an id keep a NULL id
    and take part; a component without any id has a NULL component_id. text_hash
    is xxhash64 of the text. Other columns are left aside; no rows give no rows.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    marked = settle(with_fingerprints(docs, id_column, text_column)).rows
    fps = settle(marked.groupBy("_fp").agg(F.min("_id").alias("_least_id")))
    roots = fingerprint_components(Settled(fps.rows.select("_fp"), fps.count), radius)
    rooted = settle(
        fps.rows.join(roots, F.col("_fp") == F.col("node"), "left").select(
            "_fp", "_least_id", F.coalesce("root", "_fp").alias("_root")
        )
    ).rows
    least = rooted.groupBy("_root").agg(F.min("_least_id").alias("component_id"))
    # A component of very many fingerprints is one key here.
    of_fp = spread_join(rooted.select("_fp", "_root"), least, ["_root"], "inner").select(
        "_fp", "component_id"
    )
    return spread_join(marked, of_fp, ["_fp"], "inner").select(
        F.col("_id").alias(id_column),
        F.col("_hash").alias("text_hash"),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Rows that repeat an id and a text are one document and stay or go together,
    as do rows without an id that are in a component where none has one.
    """
    found = near_duplicates(docs, radius, id_column, text_column)
    lost = found.where(~F.col(id_column).eqNullSafe(F.col("component_id")))
    return bloom.without_rows(docs, lost, id_column, text_column, id_column, "text_hash")
