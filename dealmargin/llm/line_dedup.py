"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded as two hashes each, the distinct documents of each hash are
counted, lines over the threshold are dropped, and the text is put together
again by line position. Only hashes move, and at the end the texts of documents
that lose a line, to meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm import bloom
from dealmargin.llm.columns import BLANKS, ascii_lower, enclosed, let, text_or_empty, without
from dealmargin.operators.joins import settle, spread_join

MIN_LENGTH = 20
MIN_DOCUMENTS = 3


def split_lines(text: Column) -> Column:
    """Lines between line feeds; NULL and the empty text are one empty line."""
    return F.split(text_or_empty(text), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """Lines without those at the ascending 0-based positions in dropped.

    Slices between neighbouring dropped positions, so the work is linear.
    """
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))

    def between(e: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(e) - 1),
            lambda i: F.slice(lines, F.get(e, i - 1) + 2, F.get(e, i) - F.get(e, i - 1) - 1),
        )
        return F.flatten(gaps)

    return F.when(F.size(dropped) == 0, lines).otherwise(let(ends, between))


def drop_shared_lines(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Documents with their text as it is kept, n_lines before and n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, A-Z in
    lower case. Keys of at least min_length code points found in at least
    min_documents documents lose all their lines, except in the document with
    the largest id holding them, which keeps all of them.

    NULL text is one empty line, so the text that stays is empty. Rows that
    repeat an id are one document in the count and keep the same lines; rows
    without an id are together one document, taken as the smallest id. Other
    columns pass through; columns called n_lines or n_dropped are replaced.
    """
    docs = without(docs, "n_lines", "n_dropped")
    own, text = F.col(id_column), F.col(text_column)
    row_key = F.xxhash64(text)
    keyed = docs.select(
        own.alias("_id"),
        row_key.alias("_row"),
        F.posexplode(F.transform(split_lines(text), line_key)).alias("_at", "_key"),
    ).where(F.length("_key") >= min_length)
    # Two hashes with different seeds: 128 bits that stay in the aggregate's fixed-width buffer.
    lines = keyed.select(
        "_id",
        "_row",
        "_at",
        F.xxhash64("_key").alias("_h"),
        F.xxhash64(F.lit(1), "_key").alias("_g"),
    )
    no_id = F.max(F.when(F.col("_id").isNull(), 1).otherwise(0))
    shared = (
        lines.groupBy("_h", "_g")
        .agg(
            (F.count_distinct("_id") + no_id).alias("_n"),
            F.max("_id").alias("_keeper"),
        )
        .where(F.col("_n") >= min_documents)
        .drop("_n")
    )
    lost = settle(
        spread_join(lines, shared, ["_h", "_g"], "inner")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_row")
        .agg(F.sort_array(F.collect_set("_at")).alias("_lost"))
        .select(F.col("_id").alias("_lost_id"), F.col("_row").alias("_lost_row"), "_lost")
    )
    # Rows that the filter of losing ones rules out stay where they are.
    blocks = bloom.block_count(lost.count)
    pairs = lost.rows.select(F.xxhash64("_lost_id", "_lost_row").alias("_pair"))
    hashed = enclosed(docs, _id=own, _row=row_key, _text=text)
    probed = bloom.with_possible(
        hashed.withColumn("_pair", F.xxhash64("_id", "_row")),
        bloom.bloom_filter(pairs, "_pair", blocks),
        "_pair",
        blocks,
        "_maybe",
    )
    nothing = F.array().cast("array<int>")
    losing = probed.where("_maybe").join(
        lost.rows,
        F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_row") == F.col("_lost_row")),
        "left",
    )
    met = probed.where(~F.col("_maybe")).select("_own", "_text", nothing.alias("_dropped")).union(
        losing.select("_own", "_text", F.coalesce("_lost", nothing))
    )
    kept = F.when(F.size("_dropped") == 0, text_or_empty(F.col("_text"))).otherwise(
        F.array_join(kept_lines(F.col("_lines"), F.col("_dropped")), "\n")
    )
    # A column of its own: within the lambda of kept_lines a text would be split again and again.
    return met.withColumn("_lines", split_lines(F.col("_text"))).select(
        *[kept.alias(c) if c == text_column else F.col("_own")[c].alias(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_dropped").cast("long").alias("n_dropped"),
    )
