"""Checking a column of date requests before any lookup runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealmargin.functions.dates import all_digits, format_ymd, is_valid_ymd


def _checked(requests: DataFrame, column: str) -> DataFrame:
    """The requests with their digits and what is wrong with them, if anything.

    The digits come out of a generator, not a plain projection: a filter on the
    reason would pull a projection into itself and strip the text once for
    every mention of the digits.
    """
    digits = all_digits(F.coalesce(F.col(column), F.lit("")))
    return requests.select("*", F.explode(F.array(digits)).alias("_digits")).withColumn(
        "reason",
        F.when(F.length("_digits") == 0, "empty")
        .when(F.length("_digits") != 8, "not eight digits")
        .when(~is_valid_ymd(F.col("_digits")), "no such date"),
    )


def validate_inputs(requests: DataFrame, column: str) -> DataFrame:
    """The requests naming a real day, with that day as YYYY-MM-DD text in request_date."""
    valid = _checked(requests, column).where(F.col("reason").isNull())
    return valid.withColumn("request_date", format_ymd(F.col("_digits"))).drop("_digits", "reason")


def input_rejects(requests: DataFrame, column: str) -> DataFrame:
    """The other requests, with the reason."""
    return _checked(requests, column).where(F.col("reason").isNotNull()).drop("_digits")
