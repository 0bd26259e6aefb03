"""Newest row per key."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY, _HOUR, _MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000
# Microseconds later than any time up to the year 28 000, and a step above any range of ties.
_NEVER = 9 * 10**17
_STEP = Decimal(10**20)


def _microseconds(clock: Column) -> Column:
    """Microseconds from 1970 to a time without zone, whatever the session's zone."""
    seconds = F.extract(F.lit("SECOND"), clock)
    return (
        F.unix_date(clock.cast("date")).cast("long") * _DAY
        + F.hour(clock).cast("long") * _HOUR
        + F.minute(clock).cast("long") * _MINUTE
        # a factor of few digits, so that the product still fits a long inside
        + (seconds * F.lit(Decimal(1_000_000))).cast("long")
    )


def newest_order(clock: Column, tie: Column) -> Column:
    """One number that orders by time and then by tie, a missing time last.

    A time of 18 digits and a tie of 20 fill a decimal of 38, which an aggregate
    keeps in place; a struct would make it sort before and after the shuffle.
    Any long is a tie, negative ones too.
    """
    at = F.coalesce(F.least(_microseconds(clock), F.lit(_NEVER - 1)), F.lit(_NEVER))
    return (at.cast("decimal(18,0)") * F.lit(_STEP) + tie.cast("decimal(19,0)")).cast(
        "decimal(38,0)"
    )


def latest_by(
    rows: DataFrame, key: str, order_col: str, tie_col: str, payload: str
) -> DataFrame:
    """One row per key with the payload of the newest row, an undated row counting as newest.

    Ties go to the larger tie_col. A hash aggregate rather than a window or a
    sort: rows of a key are reduced on the map side, so a key holding much of
    the table never gathers in one task. The newest row wins even where its
    payload is NULL.
    """
    order = newest_order(F.col(order_col), F.col(tie_col))
    return rows.groupBy(key).agg(F.max_by(payload, order).alias(payload))
