"""Date rules as native column expressions."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar days in ISO numbering, and the accepted input shapes.
MONDAY, SATURDAY, SUNDAY = 1, 6, 7
EIGHT_DIGITS = r"^[0-9]{8}\z"
ISO_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def iso_weekday(day: Column) -> Column:
    return F.extract(F.lit("DAYOFWEEK_ISO"), day)


def _shift_weekend(day: Column, saturday: int, sunday: int) -> Column:
    weekday = iso_weekday(day)
    return F.date_add(
        day, F.when(weekday == SATURDAY, saturday).when(weekday == SUNDAY, sunday).otherwise(0)
    )


def closing_date(day: Column) -> Column:
    """The closing date a calendar day belongs to.

    First ten days: the 10th, moved on to Monday from a weekend. Next ten days:
    the 20th, moved on likewise, unless the 10th of the month is itself on a
    weekend, when the unmoved 10th is kept. Rest of the month: the last day,
    moved back to Friday from a weekend. The result may precede the input.
    """
    first = F.trunc(day, "month")
    tenth, twentieth = F.date_add(first, 9), F.date_add(first, 19)
    return (
        F.when(F.dayofmonth(day) <= 10, _shift_weekend(tenth, 2, 1))
        .when(
            F.dayofmonth(day) <= 20,
            F.when(iso_weekday(tenth) >= SATURDAY, tenth).otherwise(
                _shift_weekend(twentieth, 2, 1)
            ),
        )
        .otherwise(_shift_weekend(F.last_day(day), -1, -2))
    )


def all_digits(text: Column) -> Column:
    """The ASCII digits of a text."""
    return F.regexp_replace(text, "[^0-9]", "")


def digits_only(text: Column) -> Column:
    """What a date input lets one type: ASCII digits, at most the first eight of them."""
    return F.substring(all_digits(text), 1, 8)


def is_valid_ymd(digits: Column) -> Column:
    """Eight digits naming a real calendar day of year 100 or later; never NULL.

    Worked out from the month's last day rather than by parsing, which raises
    and catches an exception inside Spark for every text naming no day.
    """
    year, month, day = (
        F.substring(digits, start, length).try_cast("int")
        for start, length in ((1, 4), (5, 2), (7, 2))
    )
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(
        digits.rlike(EIGHT_DIGITS) & (year >= 100) & month.between(1, 12), day.between(1, last)
    ).otherwise(F.lit(False))


def format_ymd(digits: Column) -> Column:
    """Eight digits as YYYY-MM-DD; NULL for any other number of them."""
    dashed = F.concat_ws(
        "-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    )
    return F.when(F.length(digits) == 8, dashed)


def is_iso_date(text: Column) -> Column:
    """Shape check only: a missing text and 2025-02-31 differ from each other here."""
    return F.coalesce(text, F.lit("")).rlike(ISO_SHAPE)


def as_ymd(day: Column) -> Column:
    """A date as eight digits, the form the date inputs start from."""
    return F.date_format(day, "yyyyMMdd")


def days_before(day: Column, days: int) -> Column:
    return F.date_sub(day, days)


def parse_date(value: datetime.date | str) -> datetime.date:
    """A query's date parameter: a date, the day of a time, or a real day as YYYY-MM-DD text."""
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    if not re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", value or ""):
        raise ValueError(f"date must look like YYYY-MM-DD: {value!r}")
    return datetime.date.fromisoformat(value)
