from __future__ import annotations

import json
from decimal import Decimal

import pytest

from dealmargin.operators import export, grid, search
from dealmargin.operators.grid import Both, Condition, Either
from tests.conftest import day


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Kim Min", 10), (2, "kim su", 20), (3, "Lee", 30), (4, None, None), (5, "", 40)],
        "id long, name string, score int",
    )


def ids(rows):
    return sorted(r.id for r in rows.collect())


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [
        ("contains", "KIM", [1, 2]), ("notContains", "kim", [3, 4, 5]), ("equals", "LEE", [3]),
        ("notEqual", "lee", [1, 2, 4, 5]), ("startsWith", "kim", [1, 2]), ("endsWith", "N", [1]),
        ("blank", None, [4, 5]), ("notBlank", None, [1, 2, 3]),
    ],
)
def test_text_filters(people, op, value, expected):
    assert ids(grid.grid_filter(people, {"name": Condition(op, value)})) == expected


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        (Condition("equals", 20), [2]), (Condition("notEqual", 20), [1, 3, 5]),
        (Condition("lessThan", 20), [1]), (Condition("lessThanOrEqual", 20), [1, 2]),
        (Condition("greaterThan", 20), [3, 5]), (Condition("greaterThanOrEqual", 20), [2, 3, 5]),
        (Condition("inRange", 20, 30), [2, 3]), (Condition("blank"), [4]),
        (Condition("notBlank"), [1, 2, 3, 5]),
    ],
)
def test_number_filters(people, condition, expected):
    assert ids(grid.grid_filter(people, {"score": condition})) == expected


def test_joined_conditions(people):
    either = Either((Condition("equals", 10), Condition("greaterThan", 30)))
    both = Both((Condition("greaterThan", 10), Condition("lessThan", 30)))
    assert ids(grid.grid_filter(people, {"score": either})) == [1, 5]
    assert ids(grid.grid_filter(people, {"score": both, "name": Condition("contains", "k")})) == [2]


def test_sort(people):
    rows = grid.apply_sort(people, [("name", "none"), ("score", "desc")]).collect()
    assert [r.id for r in rows] == [5, 3, 2, 1, 4]
    rows = grid.apply_sort(people, [("score", "asc")]).collect()
    assert [r.id for r in rows] == [4, 1, 2, 3, 5]


def test_totals_ignore_the_side(spark):
    lines = spark.createDataFrame(
        [("대변", Decimal(100000), "삼별"), ("대변", Decimal(100000), "하나로"), ("차변", Decimal(500000), "")],
        "side string, amount decimal(15,0), vendor_name string",
    )
    rows = grid.grid_totals(lines, ["amount"], "side").collect()
    assert len(rows) == 4
    assert [tuple(r) for r in rows if r.side == "합계"] == [("합계", Decimal(700000), "")]
    empty = grid.grid_totals(lines.where("amount < 0"), ["amount"], "side").collect()
    assert [tuple(r) for r in empty] == [("합계", Decimal(0), "")]


def test_update_merges_the_last_change(spark, people):
    changes = spark.createDataFrame(
        [(1, 1, 5), (2, 1, 6), (1, 3, None), (1, 99, 7)], "seq long, id long, score int"
    )
    rows = {r.id: (r.name, r.score) for r in grid.update_rows(people, changes, "id", "seq").collect()}
    assert rows == {
        1: ("Kim Min", 6), 2: ("kim su", 20), 3: ("Lee", None), 4: (None, None), 5: ("", 40)
    }


def test_first_row_and_counts(people):
    assert grid.fetch_one(people.where("id = 3")).collect()[0].name == "Lee"
    assert grid.fetch_one(people.where("id = 9")).collect() == []
    assert grid.preview(people).count() == 5 and grid.preview(people, 2).count() == 2
    rows, seen = grid.counted(people)
    assert len(rows.collect()) == seen.get["row_count"] == 5


def test_json_rows(spark):
    rows = spark.createDataFrame(
        [(1, Decimal("12.5"), day("2025-01-02"), None)], "id long, a decimal(5,1), d date, n string"
    )
    text = export.result_json(rows).collect()[0].json
    assert json.loads(text) == {"id": 1, "a": "12.5", "d": "2025-01-02", "n": None}


def test_csv_round_trip(spark, people, tmp_path):
    path = str(tmp_path / "grid")
    export.export_csv(people.where("name <> ''"), path)
    back = spark.read.option("header", True).schema(people.schema).csv(path)
    assert sorted(map(tuple, back.collect())) == [(1, "Kim Min", 10), (2, "kim su", 20), (3, "Lee", 30)]


@pytest.fixture(scope="module")
def vouchers(spark):
    return spark.createDataFrame(
        [("F1", day("2020-08-01"), "승인"), ("F2", day("2020-08-26"), "미결"), ("F3", day("2020-08-27"), "승인")],
        "voucher_no string, acc_date date, status string",
    )


def numbers(rows):
    return sorted(r.voucher_no for r in rows.collect())


def test_conditions(vouchers):
    def search_for(**values):
        return numbers(search.apply_conditions(vouchers, search.VOUCHERS, values))

    assert search_for(date_range="2020/08/01 - 2020/08/26") == ["F1", "F2"]
    assert search_for(status="승인") == ["F1", "F3"]
    assert search_for(status=search.ANY) == ["F1", "F2", "F3"]
    assert search_for(unit="", date_range="") == ["F1", "F2", "F3"]
    with pytest.raises(ValueError, match="no column"):
        search_for(unit="HQ")
    with pytest.raises(ValueError, match="no such search field"):
        search_for(nonsense="1")
    with pytest.raises(ValueError):
        search_for(date_range="2020/02/31 - 2020/03/01")


def test_keyword_looks_at_every_text_column(vouchers):
    assert numbers(search.search_keyword(vouchers, "f1")) == ["F1"]
    assert numbers(search.search_keyword(vouchers, "미")) == ["F2"]
    assert numbers(search.search_keyword(vouchers, "")) == ["F1", "F2", "F3"]


def test_header_without_detail_keeps_its_row(spark, vouchers):
    details = spark.createDataFrame(
        [("F1", Decimal(1)), ("F1", Decimal(2)), (None, Decimal(9))],
        "voucher_no string, amount decimal(15,0)",
    )
    rows = search.header_detail(vouchers, details, "voucher_no").collect()
    assert {r.voucher_no: (r.detail_count, int(r.detail_amount)) for r in rows} == {
        "F1": (2, 3), "F2": (0, 0), "F3": (0, 0)
    }
