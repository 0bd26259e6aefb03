"""Benchmark decontamination by winnowing.

Texts are read as words. Of every run of GRAMS consecutive k-grams the one with
the smallest hash is kept, so a span of k + GRAMS - 1 words that document and
item share leaves at least one fingerprint at the same place in both. Equal
fingerprints are joined and extended word by word; what reaches a whole window
is hit. Fingerprints of the items are broadcast up to BROADCAST_ROWS, and then
the documents are read once and only hits are shuffled; beyond it they meet in
a shuffle that carries no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm import bloom
from dealmargin.llm.columns import ascii_lower, let, text_or_empty
from dealmargin.operators.joins import settle, spread_join

WINDOW = 10
GRAM = 5
# A row holds at most 3 * WINDOW words and the ids of the items sharing them: some 30 MB.
BROADCAST_ROWS = 50_000
# Documents are cut into runs of windows starting in so many words each: a hit
# carries the words around it, and so never those of a whole long document.
BLOCK_WORDS = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HIGH, _LOW = -(1 << 32), (1 << 32) - 1


def text_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; NULL has none."""
    return F.array_remove(F.split(ascii_lower(text_or_empty(text)), SEPARATORS, -1), "")


def _gram_size(span: Column, window: int, gram: int) -> Column:
    return F.when(span == window, gram).otherwise(span)


def _marks(hashes: Column, span: int, gram: int) -> Column:
    """Fingerprints of a text as (pos, span, hash), for windows of span words.

    With gram < span the grams are winnowed: of span - gram + 1 neighbours the
    smallest stays, the first of equal ones. With gram = span all stay.
    """
    run = span - gram + 1
    grams = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - gram),
        lambda i: F.xxhash64(F.lit(span), *[F.get(hashes, i + j) for j in range(gram)]),
    )

    def chosen(hashed: Column) -> Column:
        def mark(p: Column) -> Column:
            return F.struct(
                p.cast("int").alias("_pos"),
                F.lit(span).alias("_span"),
                F.get(hashed, p.cast("int")).alias("_hash"),
            )

        if run == 1:
            return F.transform(F.sequence(F.lit(0), F.size(hashed) - 1), mark)
        # The upper half of the hash and the position: the smallest is the first smallest.
        ordered = F.transform(hashed, lambda g, i: g.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i))
        least = let(
            ordered,
            lambda o: F.transform(
                F.sequence(F.lit(0), F.size(o) - run),
                lambda i: F.least(*[F.get(o, i + j) for j in range(run)]).bitwiseAND(F.lit(_LOW)),
            ),
        )
        return F.transform(F.array_distinct(least), mark)

    none = F.array().cast("array<struct<_pos:int,_span:int,_hash:bigint>>")
    return F.when(F.size(hashes) >= span, let(grams, chosen)).otherwise(none)


def _all_marks(words: Column, spans: list[tuple[int, int]]) -> Column:
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.concat(*[_marks(hashes, span, gram) for span, gram in spans]),
    )


def _around(words: Column, pos: Column, span: Column, gram: Column) -> list[Column]:
    """The words of a gram, those before it from the nearest on, and those after it."""
    reach = span - gram
    before = F.slice(words, F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, reach))
    return [
        F.slice(words, pos + 1, gram),
        F.reverse(before),
        F.slice(words, pos + gram + 1, reach),
    ]


def _common_prefix(a: Column, b: Column) -> Column:
    return let(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)),
        lambda same: F.coalesce(
            F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)
        ),
    )


def _blocks(words: Column, window: int) -> Column:
    """Words cut so that each window starts and ends in one block, as (_n, _at, _words).

    _n counts all words and _at those before the block. No words are one empty block.
    """
    return let(
        words,
        lambda all_words: F.transform(
            F.sequence(
                F.lit(0),
                F.greatest(F.size(all_words) - 1, F.lit(0)),
                F.lit(BLOCK_WORDS),
            ),
            lambda at: F.struct(
                F.size(all_words).cast("long").alias("_n"),
                at.alias("_at"),
                F.slice(all_words, at + 1, BLOCK_WORDS + window - 1).alias("_words"),
            ),
        ),
    )


def _item_index(items: DataFrame, window: int, gram: int) -> DataFrame:
    """Fingerprints of the items with the words around them and the ids of the items there."""
    words = F.col("_words")
    span = F.least(F.size(words), F.lit(window))
    spans = [(s, s) for s in range(1, window)] + [(window, gram)]
    size = _gram_size(F.col("_span"), window, gram)
    return (
        items.withColumn("_mark", F.explode(_all_marks(words, spans)))
        .select("_item", "_words", "_mark.*")
        .where(F.col("_span") == span)
        .select(
            "_item",
            "_span",
            "_hash",
            *[
                c.alias(n)
                for c, n in zip(
                    _around(words, F.col("_pos"), F.col("_span"), size),
                    ("_gram", "_before", "_after"),
                    strict=True,
                )
            ],
        )
        .groupBy("_span", "_hash", "_gram", "_before", "_after")
        .agg(F.collect_set("_item").alias("_items"))
    )


def _covered(ranges: Column) -> Column:
    """How many positions ranges (from, to) cover, those in several counted once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array(ranges),
        start,
        lambda acc, r: F.struct(
            F.greatest(acc["end"], r["to"]).alias("end"),
            (
                acc["n"] + F.greatest(F.lit(0), r["to"] - F.greatest(acc["end"], r["from"]))
            ).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document: its id, text_hash, n_words, n_hit and items.

    An item's windows are its runs of window words; a shorter item is one
    window, a wordless one none. A document word is hit if it lies in an
    occurrence of a window. items are the ids, as strings and sorted as such, of
    the items with an occurring window; an item without an id counts for n_hit
    alone. text_hash is xxhash64 of the text and tells rows that repeat an id
    apart; identical rows come back as often as they were given.

    NULL texts have no words. No items, or only wordless ones, hit nothing; no
    documents give no rows. Other columns are left aside.
    """
    listed = items.select(
        F.col(item_column).cast("string").alias("_item"),
        text_words(F.col(item_text_column)).alias("_words"),
    ).where(F.size("_words") > 0)
    index = settle(_item_index(listed, window, gram))
    spans = sorted(
        (s, gram if s == window else s)
        for (s,) in index.rows.select("_span").distinct().collect()  # at most window values
    )
    words = docs.select(
        F.col(id_column).alias("_id"),
        F.xxhash64(F.col(text_column)).alias("text_hash"),
        F.inline(_blocks(text_words(F.col(text_column)), window)),
    )
    whole = F.struct(
        F.lit(-1).alias("_pos"),
        F.lit(None).cast("int").alias("_span"),
        F.lit(None).cast("long").alias("_hash"),
    )
    found = _all_marks(F.col("_words"), spans) if spans else F.array()
    # The first mark of a row stands for the row itself and meets no item.
    marked = words.withColumn(
        "_all", F.when(F.col("_at") == 0, F.concat(F.array(whole), found)).otherwise(found)
    ).select("_id", "text_hash", "_n", "_at", "_words", F.inline("_all"))
    keys = ["_span", "_hash"]
    if index.count <= broadcast_rows:
        met = marked.join(F.broadcast(index.rows), keys, "left").where(
            (F.col("_pos") < 0) | F.col("_items").isNotNull()
        )
    else:
        same = [
            F.col("_id").eqNullSafe(F.col("_doc")),
            F.col("text_hash") == F.col("_doc_hash"),
            F.col("_at") == F.col("_block"),
        ]
        anchors = (
            spread_join(marked.where("_pos >= 0").drop("_words", "_n"), index.rows, keys, "inner")
            .distinct()
            .withColumnsRenamed({"_id": "_doc", "text_hash": "_doc_hash", "_at": "_block"})
        )
        hits = words.join(anchors, same).drop("_doc", "_doc_hash", "_block")
        rows = marked.where("_pos < 0").drop("_words")
        met = rows.unionByName(hits, allowMissingColumns=True)
    span, pos = F.col("_span"), F.greatest(F.col("_pos"), F.lit(0))
    size = _gram_size(span, window, gram)
    core, before, after = _around(F.col("_words"), pos, span, size)
    extended = met.select(
        "_id",
        "text_hash",
        "_n",
        "_pos",
        "_items",
        (F.col("_pos") >= 0).alias("_met"),
        (core == F.col("_gram")).alias("_same"),
        (span <= size + _common_prefix(before, F.col("_before"))
         + _common_prefix(after, F.col("_after"))).alias("_long"),
        (F.col("_at") + pos - _common_prefix(before, F.col("_before")))
        .cast("int")
        .alias("_from"),
        (F.col("_at") + pos + size + _common_prefix(after, F.col("_after")))
        .cast("int")
        .alias("_to"),
    ).where(~F.col("_met") | (F.col("_same") & F.col("_long")))
    hit = F.when(F.col("_met"), F.struct(F.col("_from").alias("from"), F.col("_to").alias("to")))
    of_row = extended.groupBy("_id", "text_hash").agg(
        F.max("_n").alias("n_words"),
        F.count_if(~F.col("_met")).alias("_copies"),
        F.collect_set(hit).alias("_hits"),
        F.collect_set(F.when(F.col("_met"), F.col("_items"))).alias("_of"),
    )
    return of_row.select(
        F.col("_id").alias(id_column),
        "text_hash",
        "n_words",
        _covered(F.col("_hits")).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("_of"))).alias("items"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark item hits, with all their columns."""
    own = options.get("id_column", "doc_id")
    text = options.get("text_column", "text")
    hit = contamination(docs, items, **options).where(F.col("n_hit") > 0)
    return bloom.without_rows(docs, hit, own, text, own, "text_hash")
