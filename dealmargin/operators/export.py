"""Results leaving Spark: JSON rows and CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# What stands for NULL in a CSV file; a text that looks like it gets one more backslash.
NULL_MARK = "\\N"
_LIKE_MARK = r"^\\+N$"
_CSV = {
    "header": True,
    "nullValue": NULL_MARK,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def result_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row: decimals as texts, dates in ISO form, NULLs kept."""
    columns = [
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("decimal", "date")
        else F.col(f.name)
        for f in rows.schema.fields
    ]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def _marked(schema: StructType, out: bool) -> list[Column]:
    """The columns with texts that look like the mark of NULL made different, or that undone."""

    def column(name: str) -> Column:
        text = F.col(f"`{name}`")
        changed = F.concat(F.lit("\\"), text) if out else F.substring(text, 2, 2**31 - 1)
        return F.when(text.rlike(_LIKE_MARK), changed).otherwise(text).alias(name)

    return [
        column(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
        for f in schema.fields
    ]


def export_csv(rows: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """The rows as CSV files with a header line each, in which NULL and empty texts differ.

    With an order the rows are sorted by ranges, so that the files read by name,
    one after the other, are in that order as a whole; rows that are sorted
    already are written as they come. NULL is written as \\N, an empty text as a
    pair of quotes; read_csv gives back the rows as they were.
    """
    shown = rows.orderBy(*order) if order else rows
    writer = shown.select(*_marked(rows.schema, out=True)).write.mode("overwrite")
    writer.options(**_CSV, emptyValue='""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of export_csv; texts may hold quotes, separators and line breaks."""
    stored = spark.read.options(**_CSV, emptyValue="", multiLine=True).schema(schema).csv(path)
    return stored.select(*_marked(schema, out=False))
