"""The thin queries of this package and their SQL, as registered by the entry point."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmargin.llm import (
    conversation_repair,
    decontamination,
    exact_dedup,
    language_id,
    line_dedup,
    packing,
    perplexity,
    pii,
    prefix_trie,
    secrets,
    sharding,
    simhash,
    sql,
    url_filter,
)
from dealmargin.llm.columns import text_or_empty

# A stand-in: production passes a key of its own to the operator.
SURROGATE_KEY = "query-key"
SHARDS = 24
# The ranks of byte_bpe_50k.json, the same vocabulary in the form the faster library reads.
RANKS = "byte_bpe_50k.tiktoken"
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# The listing holds the pages whose canonical URL's MD5 begins with this digit, a sixteenth.
LISTED_DIGIT = "7"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, SURROGATE_KEY).select(
        "doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities"
    )


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_stratified_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = text_or_empty(F.col("text"))
    rows = _table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return sharding.interleaved_shards(rows, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op5_perplexity_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = perplexity.judged_documents(_table(spark, folder, "documents"))
    return judged.select("doc_id", *perplexity.BASE, "base_failed", "kept", "surprise")


def op6_multipart_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, folder, "documents"))

    def count(rank: int) -> Column:
        return F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(F.col("strong")), 256).alias("base_sha256"),
        secrets.spans_text(F.concat("strong", "weak")).alias("spans"),
    )


def op7_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(
        _table(spark, folder, "documents"), public_tokenizers.path(RANKS)
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).drop("text_hash")


def listed_urls(pages: DataFrame) -> DataFrame:
    digest = F.md5(F.concat(F.lit("listing:"), url_filter.canonical_url(F.col("url"))))
    return pages.where(digest.startswith(LISTED_DIGIT)).select("url")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, listed_urls(pages), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def held_out() -> Column:
    """Whether a document is none to learn from: by the CRC of its id as text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(own) % 4 == 2


def op10_byte_cnn_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    network = language_id.fit(docs.where(~held_out()), key=F.col("doc_id"))
    return language_id.predict(docs, network).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op11_content_sort_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"), keep="largest")


def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of conversations that begin with turns of the first of their hundred."""
    own = F.col("conv_id")
    rebuilt = prefix_trie.prefixes(
        _table(spark, folder, "conversations"),
        taken=F.crc32(own.cast("string")) % 6,
        head=own - own % 100,
    )
    return prefix_trie.prefix_trie(rebuilt)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, robbed of their marks, repeated or given to the user, by a hash."""
    space = F.lit(" ")
    number = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    )
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    kind = F.crc32(number) % 20
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind == 1, "")
            .when(kind == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            kind.alias("_kind"),
        )
        .where(F.col("_kind") != 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))))
        .drop("_kind", "_copy")
    )


def op13_conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    whole = _table(spark, folder, "conversations")
    mended = conversation_repair.repaired_conversations(damaged(whole))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    digests = mended.select(
        F.col("conv_id").alias("_own"),
        *counts,
        "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )
    every = whole.select("conv_id").distinct()
    return every.join(digests, F.col("conv_id").eqNullSafe(F.col("_own")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_stratified_sharding": op3_stratified_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_perplexity_quality": op5_perplexity_quality,
    "op6_multipart_secrets": op6_multipart_secrets,
    "op7_vector_packing": op7_vector_packing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_byte_cnn_language": op10_byte_cnn_language,
    "op11_content_sort_dedup": op11_content_sort_dedup,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_conversation_structure_repair": op13_conversation_structure_repair,
}
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": sql.DECONTAMINATION,
    "op3_stratified_sharding": sql.SHARDING,
    "op4_line_dedup": sql.LINE_DEDUP,
    "op9_url_filter": sql.URL_FILTER,
    "op11_content_sort_dedup": sql.EXACT_DEDUP,
    "op12_conversation_prefix_trie": sql.PREFIX_TRIE,
    "op13_conversation_structure_repair": sql.STRUCTURE_REPAIR,
}
