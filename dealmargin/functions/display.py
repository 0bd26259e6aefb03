"""Text forms of values as the result grid shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: grouping by thousands, up to three decimals, none when whole.
NUMBER_PATTERN = "#,##0.###"


def fmt_currency(amount: Column) -> Column:
    """Grouped number without a currency sign, three decimals at most; empty text for NULL.

    Rounded half away from zero first, as the pattern alone rounds half to even.
    """
    shown = F.call_function("format_number", F.round(amount, 3), F.lit(NUMBER_PATTERN))
    return F.coalesce(shown, F.lit(""))


def fmt_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def fmt_percent(rate: Column) -> Column:
    return F.coalesce(F.concat(rate.cast("string"), F.lit("%")), F.lit(""))
