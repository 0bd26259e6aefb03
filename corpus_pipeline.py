"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents its predecessor kept and the folder
of the tables, and returns a DataFrame that is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealmargin.llm import decontamination, line_dedup, packing, perplexity, simhash
from dealmargin.llm.registry import RANKS
from dealmargin.operators.grid import free_name
from dealmargin.session import scratch_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band.

    NULL and empty texts fail the base rules and go. Rows that repeat a text and
    a language are judged alike and stay or go together. Rows without a language
    are one language. No rows give no rows; all columns stay, whatever their names.
    """
    return perplexity.kept_documents(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; n_chars follows the text.

    A NULL text becomes empty, and so does one that loses all its lines; every
    row stays. Rows that repeat an id are one document and keep the same lines.
    No rows give no rows; all columns stay, whatever their names.
    """
    carried = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in _LINE_COUNTS}
    kept = line_dedup.drop_shared_lines(docs.withColumnsRenamed(carried)).drop(*_LINE_COUNTS)
    kept = kept.withColumnsRenamed({own: c for c, own in carried.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


_LINE_COUNTS = ("n_lines", "n_dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Texts without words, NULL among them, are near-duplicates of each other.
    Rows that repeat an id and a text are one document and stay together, as do
    rows without an id where a group has no other. No rows give no rows; all
    columns stay, whatever their names.
    """
    return simhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item.

    NULL and empty texts share none and stay. Repeated rows stay or go together.
    No rows give no rows, no items take none; all columns stay, whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_contaminated(docs, items)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences.

    A NULL or empty text is the closing token alone. Repeated rows are packed
    each, rows without an id too. No rows give no rows; only id and text are read.
    """
    return packing.pack_documents(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", shared_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# Perplexity, fingerprints and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last one's result is not stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
