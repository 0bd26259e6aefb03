"""Quality rules: character n-gram perplexity within language-specific bands.

The model is modified Kneser-Ney over 4-grams of UTF-16 units, one per language.
It learns from all documents with clean base signals, so junk does not teach it;
grams that only other documents have get their probability from shorter ones.
Tasks count the grams of their rows, Spark sums the counts over the whole corpus
and turns them into probabilities order by order. Scoring has an entry for every
gram, in arrays sorted by a 64-bit key. A large model is cut into ranges of the
key of about RANGE_GRAMS entries: the driver holds one of them at a time, and a
task takes one after the other for each of its chunks of documents.

A document it learnt from was counted too, so its own rarities would look
familiar. Equal texts are counted once, and a gram that only this text has is scored by its fallback, the shorter
gram that follows more than one unit.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm import bloom
from dealmargin.operators.joins import settle, spread_join
from dealmargin.session import remove_folder, scratch_dir

ORDER = 4
_UNIT = 16
RANGE_GRAMS = 1 << 22
CHUNK_GRAMS = 1 << 20
COUNTED_UNITS = 1 << 19
KEPT_GRAMS = 1 << 22
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# The model and the bands learn from documents with at most this share of symbols.
MAX_SYMBOL_PERCENT = 1
# A band reaches BAND robust standard deviations from the language's median; with
# fewer than FITTED documents to tell them, at least those of all languages together.
BAND = 8.0
FITTED = 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


# --- the text itself ---------------------------------------------------------------


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()  # on bytes: ASCII white space only
    solid = text.translate(None, _BLANKS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(solid.decode()),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
    )


def _repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def teaches(counts: tuple[int, int, int, int, int]) -> bool:
    """Whether a text with these base counts passes the base rules and has few symbols."""
    words, chars, symbols, _, repeated = counts
    return (
        words >= MIN_WORDS
        and 100 * repeated <= MAX_REPEATED_PERCENT * words
        and 100 * symbols <= MAX_SYMBOL_PERCENT * chars
    )


def grams_of(text: str) -> np.ndarray:
    """The gram ending at each UTF-16 unit, packed into 64 bits; units before the text are 0."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    padded = np.concatenate([np.zeros(ORDER - 1, dtype=np.uint64), units.astype(np.uint64)])
    grams = padded[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        grams |= padded[ORDER - 1 - back : len(padded) - back] << np.uint64(_UNIT * back)
    return grams


# --- counts and the model, in Spark ------------------------------------------------


class _Counts:
    """Counts of one language's grams, kept as sorted arrays; new grams wait until there are many."""

    def __init__(self) -> None:
        self.grams = np.zeros(0, dtype=np.uint64)
        self.n = np.zeros(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.units = 0

    def add(self, grams: np.ndarray) -> None:
        for start in range(0, len(grams), COUNTED_UNITS):
            part = grams[start : start + COUNTED_UNITS]
            self.waiting.append(part)
            self.units += len(part)
            if self.units >= COUNTED_UNITS:
                self.merge()

    def merge(self) -> None:
        if not self.units:
            return
        fresh, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.units = [], 0
        both = np.concatenate([self.grams, fresh])
        order = np.argsort(both, kind="stable")
        self.grams, first = np.unique(both[order], return_index=True)
        self.n = np.add.reduceat(np.concatenate([self.n, n])[order], first)

    def taken(self, code: str, counted: bool) -> Iterator[pa.RecordBatch]:
        self.merge()
        if not counted:
            self.n[:] = 0
        for start in range(0, len(self.grams), COUNTED_UNITS):
            grams = self.grams[start : start + COUNTED_UNITS].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([code] * len(grams), pa.string()),
                    pa.array(grams),
                    pa.array(self.n[start : start + COUNTED_UNITS]),
                ],
                names=["_lang", "_gram", "_n"],
            )


def distinct_texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Each text once for each of its languages, as _lang and _text.

    A filter of the hashes that come twice or more leaves the other texts where
    they are; the rest are compared as they are, not by their hashes.
    """
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.col(text).alias("_text")
    )
    keyed = rows.withColumn("_pair", F.xxhash64("_lang", "_text"))
    again = settle(
        keyed.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_pair")
    )
    blocks = bloom.block_count(again.count)
    known = bloom.bloom_filter(again.rows, "_pair", blocks)
    probed = bloom.with_possible(keyed, known, "_pair", blocks, "_maybe")
    once = probed.where(~F.col("_maybe")).select("_lang", "_text")
    return once.unionByName(probed.where("_maybe").select("_lang", "_text").distinct())


def gram_counts(docs: DataFrame, lang: str, text: str, clean: bool = False) -> DataFrame:
    """How often each language has each gram, as _lang, _gram and _n, over all rows.

    With clean, rows that do not teach the model have their grams listed but not
    counted, so that _n is 0 where no other row has them.
    A task counts its rows in arrays of at most about KEPT_GRAMS entries, which
    go to Spark's aggregate when they are full and at the end.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bool], _Counts] = {}
        for batch in batches:
            for code, body in zip(batch.column(0), batch.column(1), strict=True):
                if body.is_valid:
                    whole = body.as_py()
                    counted = not clean or teaches(
                        base_counts(whole.encode("utf-8", "surrogatepass"))
                    )
                    kind = code.as_py(), counted
                    found.setdefault(kind, _Counts()).add(grams_of(whole))
            if sum(len(c.grams) + c.units for c in found.values()) > KEPT_GRAMS:
                for kind, counts in found.items():
                    yield from counts.taken(*kind)
                found = {}
        for kind, counts in found.items():
            yield from counts.taken(*kind)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("")), text)
    counted = rows.mapInArrow(each, "_lang string, _gram long, _n long")
    return counted.groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """The three discounts of each language, from how many grams occur 1 to 4 times."""
    of = grams.groupBy("_lang").agg(
        *[F.count_if(F.col("_n") == i).cast("double").alias(f"_t{i}") for i in range(1, 5)]
    )
    y = F.col("_t1") / (F.col("_t1") + 2 * F.col("_t2"))

    def discount(i: int) -> Column:
        value = i - (i + 1) * y * F.col(f"_t{i + 1}") / F.col(f"_t{i}")
        known = (F.col(f"_t{i}") > 0) & (F.col("_t1") > 0)
        usual = F.lit(0.5 * i)  # where the counts of counts cannot tell
        bounded = F.least(F.greatest(value, F.lit(0.1 * i)), F.lit(0.9 * i))
        return F.when(known, bounded).otherwise(usual)

    return of.select("_lang", *[discount(i).alias(f"_d{i}") for i in range(1, 4)])


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, _UNIT)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Probability _p of each counted gram's last unit after the others, with its count _n.

    The highest order has its counts, each lower one the number of distinct
    units its grams follow. A gram without a count has what its context leaves
    for unseen units, or all of the shorter gram's share if the context has no
    count either. Orders are interpolated down to a uniform share.
    _fallback is the probability by the longest shorter gram that follows two
    units or more, or else the uniform share.
    """
    # Settled order by order: each is read several times, and the plan stays short.
    orders = [counts]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("_gram").bitwiseAND(F.lit((1 << _UNIT * order) - 1))
        follows = F.count_if(F.col("_n") > 0).alias("_n")
        shorter = orders[-1].groupBy("_lang", suffix.alias("_gram")).agg(follows)
        orders.append(settle(shorter).rows)
    known = orders[-1].groupBy("_lang").agg(F.count(F.lit(1)).alias("_units"))
    lower = None
    for order, grams in zip(range(1, ORDER + 1), reversed(orders), strict=True):
        n = F.col("_n")
        d = (
            F.when(n == 0, 0.0)
            .when(n == 1, F.col("_d1"))
            .when(n == 2, F.col("_d2"))
            .otherwise(F.col("_d3"))
        )
        discounted = (
            spread_join(grams, _discounts(grams), ["_lang"], "inner")
            .withColumn("_d", d)
            .withColumn("_context", _context(F.col("_gram")))
        )
        contexts = discounted.groupBy("_lang", "_context").agg(
            F.sum("_n").alias("_all"), F.sum("_d").alias("_held")
        )
        met = spread_join(discounted, contexts, ["_lang", "_context"], "inner").select(
            "_lang",
            "_gram",
            "_n",
            F.coalesce(F.try_divide(n - F.col("_d"), F.col("_all")), F.lit(0.0)).alias("_own"),
            F.coalesce(F.try_divide("_held", "_all"), F.lit(1.0)).alias("_backoff"),
            F.col("_gram").bitwiseAND(F.lit((1 << _UNIT * (order - 1)) - 1)).alias("_suffix"),
        )
        if lower is None:
            uniform = 1.0 / F.col("_units")
            below = spread_join(met, known, ["_lang"], "inner").withColumns(
                {"_less": uniform, "_fallback": uniform}
            )
        else:
            below = spread_join(
                met,
                lower.select(
                    "_lang",
                    F.col("_gram").alias("_suffix"),
                    F.col("_p").alias("_less"),
                    F.when(F.col("_n") > 1, F.col("_p"))
                    .otherwise(F.col("_fallback"))
                    .alias("_fallback"),
                ),
                ["_lang", "_suffix"],
                "inner",
            )
        lower = settle(
            below.select(
                "_lang",
                "_gram",
                "_n",
                (F.col("_own") + F.col("_backoff") * F.col("_less")).alias("_p"),
                "_fallback",
            )
        ).rows
    return lower


def slot_of(grams: np.ndarray, lang: str) -> np.ndarray:
    """The key of each gram: Spark's xxhash64(lang, gram), unsigned.

    Its steps can all be undone, so no two grams of one language share a key.
    """
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (  # fixed values of the hash
            0x9E3779B185EBCA87,
            0xC2B2AE3D27D4EB4F,
            0x165667B19E3779F9,
            0x85EBCA77C2B2AE63,
            0x27D4EB2F165667C5,
        )
    )

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    with np.errstate(over="ignore"):
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))
        h = turned(grams * p2, 31) * p1 ^ (seed + p5 + np.uint64(8))
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h


class Model(NamedTuple):
    """By sorted key: how often each gram occurs, and its log probabilities."""

    slots: np.ndarray
    counts: np.ndarray
    logp: np.ndarray
    fallback: np.ndarray


def _entries(probabilities: DataFrame) -> DataFrame:
    return probabilities.select(
        F.xxhash64("_lang", "_gram").alias("slots"),
        F.least("_n", F.lit((1 << 31) - 1)).cast("int").alias("counts"),
        F.log("_p").cast("float").alias("logp"),
        F.log("_fallback").cast("float").alias("fallback"),
    )


def _collected(entries: DataFrame) -> Model:
    stored = entries.select(*Model._fields).toArrow()
    slots = stored["slots"].to_numpy().view(np.uint64)
    order = np.argsort(slots)
    return Model(slots[order], *(stored[name].to_numpy()[order] for name in Model._fields[1:]))


def model_arrays(probabilities: DataFrame) -> Model:
    """The whole model, 20 bytes a gram, collected to the driver."""
    return _collected(_entries(probabilities))


def model_ranges(probabilities: DataFrame, grams: int) -> list[Broadcast]:
    """The model of so many grams as broadcast ranges of equal width, a power of two of them.

    Several ranges are written to the checkpoint folder first, so that none is
    computed or read twice.
    """
    spark = probabilities.sparkSession
    bits = max(0, -(-grams // RANGE_GRAMS) - 1).bit_length()
    if not bits:
        return [spark.sparkContext.broadcast(model_arrays(probabilities))]
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    place = F.shiftrightunsigned("slots", 64 - bits).cast("int")
    entries = _entries(probabilities).withColumn("_range", place)
    entries.write.partitionBy("_range").parquet(path)
    stored = spark.read.schema(entries.schema).parquet(path)
    ranges = [
        spark.sparkContext.broadcast(_collected(stored.where(F.col("_range") == r)))
        for r in range(1 << bits)
    ]
    remove_folder(spark, path)
    return ranges


# --- scoring -----------------------------------------------------------------------


def _log_probability(slots: np.ndarray, own: np.ndarray, model: Model) -> np.ndarray:
    """By key; own is how often the text has the gram, or 0 if the model did not learn from it."""
    at = np.searchsorted(model.slots, slots)
    return np.where((own > 0) & (own >= model.counts[at]), model.fallback[at], model.logp[at])


def mean_surprise(text: str, lang: str, model: Model, taught: bool = True) -> float:
    """Nats a unit of the text under its language's model: the log of its perplexity.

    taught tells whether the model's counts hold the text's own.
    """
    return mean_surprises([(text, lang, taught)], 0, lambda _: model)[0]


def mean_surprises(
    texts: list[tuple[str, str, bool]], bits: int, load: Callable[[int], Model]
) -> list[float]:
    """mean_surprise of each text, language and taught, by a model of 2^bits ranges of its key."""
    found = [np.unique(grams_of(text), return_counts=True) for text, _, _ in texts]
    sizes = [len(grams) for grams, _ in found]
    if not sum(sizes):
        return [0.0] * len(texts)
    slots = np.concatenate(
        [slot_of(grams, lang) for (grams, _), (_, lang, _) in zip(found, texts, strict=True)]
    )
    n = np.concatenate([n for _, n in found])
    own = n * np.repeat([taught for _, _, taught in texts], sizes)
    if bits:
        places = slots >> np.uint64(64 - bits)
        logp = np.empty(len(slots))
        for place in np.unique(places):
            here = places == place
            logp[here] = _log_probability(slots[here], own[here], load(int(place)))
    else:
        logp = _log_probability(slots, own, load(0))
    of = np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(of, logp * n, len(texts))
    units = np.bincount(of, n, len(texts))
    return (-total / np.maximum(units, 1)).tolist()


def _loaded(shared: Broadcast, keep: bool) -> Model:
    """A range's arrays, which the task's process does not hold on to unless told to."""
    model = shared.value
    if not keep and getattr(shared, "_path", None) is not None:
        del shared._value
    return model


def scored_documents(
    docs: DataFrame, id_column: str, lang: str, text: str, ranges: list[Broadcast]
) -> DataFrame:
    """Id, language, text hash, base counts and surprise of every row."""
    bits = len(ranges).bit_length() - 1
    kind = docs.schema[id_column].dataType.simpleString()

    def load(place: int) -> Model:
        return _loaded(ranges[place], keep=not bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, surprise, texts, units = [], [], [], 0
            for code, body in zip(batch.column(1), batch.column(3), strict=True):
                whole = body.as_py() or ""
                counts.append(base_counts(whole.encode("utf-8", "surrogatepass")))
                texts.append((whole, code.as_py(), teaches(counts[-1])))
                units += len(whole)
                if units >= CHUNK_GRAMS:
                    surprise += mean_surprises(texts, bits, load)
                    texts, units = [], 0
            surprise += mean_surprises(texts, bits, load)
            columns = np.array(counts, dtype=np.int64).reshape(-1, len(BASE)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, columns), pa.array(surprise, pa.float64())],
                names=["_id", "_lang", "_hash", *BASE, "surprise"],
            )

    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(lang), F.lit("")).alias("_lang"),
        F.xxhash64(F.col(text)).alias("_hash"),
        F.col(text).alias("_text"),
    )
    fields = "".join(f", {c} long" for c in BASE)
    return rows.mapInArrow(
        each, f"_id {kind}, _lang string, _hash long{fields}, surprise double"
    )


def language_bands(scored: DataFrame) -> DataFrame:
    """Lower and upper surprise of each language: its median and so many deviations around it.

    Both come from the texts that teach the model, each counted once. A language without any has no row.
    """
    prose = scored.where("_teaches").select("_lang", "_hash", "surprise").distinct()
    middle = prose.groupBy("_lang").agg(
        F.percentile_approx("surprise", 0.5, 10000).alias("_middle")
    )
    off = spread_join(prose, middle, ["_lang"], "inner").withColumn(
        "_off", F.abs(F.col("surprise") - F.col("_middle"))
    )
    typical = F.percentile_approx("_off", 0.5, 10000)
    of_all = off.agg(typical.alias("_all_off"))
    spread = F.when(F.col("_fitted") < FITTED, F.greatest("_own_off", "_all_off")).otherwise(
        F.col("_own_off")
    )
    width = spread * (1.4826 * BAND)
    return (
        off.groupBy("_lang")
        .agg(
            F.max("_middle").alias("_middle"),
            F.count(F.lit(1)).alias("_fitted"),
            typical.alias("_own_off"),
        )
        .crossJoin(F.broadcast(of_all))
        .select(
            "_lang",
            (F.col("_middle") - width).alias("lower"),
            (F.col("_middle") + width).alias("upper"),
        )
    )


def judged_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """One row per document: its id, text_hash, base counts, base_failed, surprise and kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEATED_PERCENT of
    them in repeated 3-word windows. kept is false if base_failed or if the
    surprise lies outside its language's band, which the documents set that do
    not fail the base rules and have at most MAX_SYMBOL_PERCENT symbols to their
    word_chars. A language without such documents has no band, and only the base
    rules judge it. Rows without a language are one language of their
    own. NULL and empty texts have no words, surprise 0, and fail. Equal texts
    of a language count once in its model and band and are judged alike; no
    rows give no rows. text_hash is xxhash64 of the text.
    """
    texts = distinct_texts(docs, lang_column, text_column)
    counts = settle(gram_counts(texts, "_lang", "_text", clean=True))
    ranges = model_ranges(kneser_ney(counts.rows), counts.count)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    few = 100 * F.col("n_symbols") <= MAX_SYMBOL_PERCENT * F.col("word_chars")
    scored = settle(
        scored_documents(docs, id_column, lang_column, text_column, ranges).withColumns(
            {"base_failed": failed, "_teaches": ~failed & few}
        )
    ).rows
    for each in ranges:
        each.destroy()
    inside = F.col("surprise").between(F.col("lower"), F.col("upper"))
    return spread_join(scored, language_bands(scored), ["_lang"], "left").select(
        F.col("_id").alias(id_column),
        F.col("_hash").alias("text_hash"),
        *BASE,
        "base_failed",
        "surprise",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def kept_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that are kept, with all their columns."""
    own, text = columns.get("id_column", "doc_id"), columns.get("text_column", "text")
    lost = judged_documents(docs, **columns).where(~F.col("kept"))
    return bloom.without_rows(docs, lost, own, text, own, "text_hash")
