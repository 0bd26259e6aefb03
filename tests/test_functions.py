from __future__ import annotations

import calendar
import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealmargin.functions import dates, display, rules
from dealmargin.plans import requests
from tests.conftest import day


def plain_closing_date(d):
    """The rule restated for one date."""
    def at(number):
        return d.replace(day=number)

    if d.day <= 10:
        target, shift = at(10), {5: 2, 6: 1}
    elif d.day <= 20:
        if at(11).weekday() == 0 or at(12).weekday() == 0:
            return at(10)
        target, shift = at(20), {5: 2, 6: 1}
    else:
        target, shift = at(calendar.monthrange(d.year, d.month)[1]), {5: -1, 6: -2}
    return target + datetime.timedelta(days=shift.get(target.weekday(), 0))


def test_closing_date_over_all_days(spark):
    days = spark.sql(
        "SELECT explode(sequence(DATE'1995-01-01', DATE'2030-12-31')) AS d"
    ).select("d", dates.closing_date(F.col("d")).alias("c"))
    rows = days.collect()
    assert len(rows) == 13149
    assert [r.d for r in rows if r.c != plain_closing_date(r.d)] == []
    assert sum(r.c < r.d for r in rows) == 1417


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("2026-07-05", "2026-07-10"), ("2026-10-03", "2026-10-12"), ("2026-05-08", "2026-05-11"),
        ("2026-10-15", "2026-10-10"), ("2026-05-20", "2026-05-10"), ("2026-06-15", "2026-06-22"),
        ("2026-09-12", "2026-09-21"), ("2026-01-31", "2026-01-30"), ("2026-05-31", "2026-05-29"),
    ],
)
def test_closing_date_cases(spark, given, expected):
    row = spark.range(1).select(dates.closing_date(F.lit(day(given))).alias("c")).collect()[0]
    assert row.c == day(expected)


def test_date_texts(spark):
    cases = {
        "20240229": True, "20250229": False, "20250231": False, "20251301": False,
        "2025010": False, "00500101": False, "00990101": False, "01000101": True,
        "99991231": True, "20250100": False, "20250001": False, "2025O101": False,
        "20250101\n": False, "": False, None: False, "２０２５０１０１": False, "19000229": False,
        "20000229": True,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", dates.is_valid_ymd(F.col("t")).alias("ok")
    )
    assert {r.t: r.ok for r in rows.collect()} == cases


def test_iso_shape_is_only_a_shape(spark):
    cases = {
        "2025-02-31": True, "2025-2-01": False, "2025-02-01\n": False, "": False, None: False,
        "２０２５-01-01": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", dates.is_iso_date(F.col("t")).alias("ok")
    )
    assert {r.t: r.ok for r in rows.collect()} == cases


def test_digits_and_formats(spark):
    row = spark.range(1).select(
        dates.digits_only(F.lit("2025/01-02 and 345")).alias("digits"),
        dates.format_ymd(F.lit("20250102")).alias("shown"),
        dates.as_ymd(F.lit(day("2025-01-02"))).alias("ymd"),
        dates.days_before(F.lit(day("2025-01-02")), 365).alias("since"),
        display.fmt_currency(F.lit(Decimal("-1234567"))).alias("money"),
        display.fmt_currency(F.lit(Decimal("1234.5"))).alias("part"),
        display.fmt_currency(F.lit(Decimal("0.0625"))).alias("half"),
        dates.format_ymd(F.lit("202501")).alias("short"),
        display.fmt_currency(F.lit(None).cast("decimal(15,0)")).alias("none"),
        display.fmt_date(F.lit(day("2025-01-02"))).alias("date"),
        display.fmt_date(F.lit(None).cast("date")).alias("no_date"),
        display.fmt_percent(F.lit(Decimal("55.3"))).alias("rate"),
        display.fmt_percent(F.lit(None).cast("decimal(5,1)")).alias("no_rate"),
    ).collect()[0]
    assert row.asDict() == {
        "digits": "20250102", "shown": "2025-01-02", "ymd": "20250102",
        "since": day("2024-01-03"), "money": "-1,234,567", "part": "1,234.5", "half": "0.063",
        "short": None, "none": "",
        "date": "2025-01-02", "no_date": "", "rate": "55.3%", "no_rate": "",
    }


def test_requests_are_split_with_reasons(spark):
    given = spark.createDataFrame(
        [(1, "2025/01/02"), (2, "20250231"), (3, "2025"), (4, None), (5, "x"),
         (6, "20250102345"), (7, "2025-01-02 and 345")],
        "id int, raw string",
    )
    good = requests.validate_inputs(given, "raw").collect()
    assert [(r.id, r.request_date) for r in good] == [(1, "2025-01-02")]
    bad = requests.input_rejects(given, "raw").collect()
    assert {r.id: r.reason for r in bad} == {
        2: "no such date", 3: "not eight digits", 4: "empty", 5: "empty",
        6: "not eight digits", 7: "not eight digits",
    }


def test_roles(spark):
    rows = spark.createDataFrame([("admin",), ("user",), ("root",), ("Admin",), (None,)], "r string")
    allowed = rows.select("r", rules.role_allowed(F.col("r")).alias("ok")).collect()
    assert {r.r for r in allowed if r.ok} == {"admin", "user"}
    assert all(r.ok is not None for r in allowed)


def test_date_parameters():
    assert dates.parse_date("2026-07-10") == dates.parse_date(day("2026-07-10")) == day("2026-07-10")
    for wrong in ("", None, "20260710", "2025-02-31", "2026-07-10\n", "２０２６-07-10"):
        with pytest.raises(ValueError):
            dates.parse_date(wrong)
