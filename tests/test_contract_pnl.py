from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealmargin.functions import rules
from dealmargin.operators import joins
from dealmargin.operators.latest import latest_by
from dealmargin.plans import all_dates
from dealmargin.plans import contract_pnl as pnl
from tests.conftest import GOLDEN, GOLDEN_DATE, clock, day, rows_of

MAPPED_DATE = datetime.date(1995, 12, 29)

FIRST = {
    "id": 1, "doc_id": "D-1", "doc_name": "n1", "team": "TeamA", "user": "E1",
    "expected_sale": 1000000, "occurred_sale": 800000, "uncollected_sale": 500000,
    "gain": -50000, "remain_sale": 200000, "biz_done": True, "biz_note": "x",
    "purchase_total": 350000, "sum_product": 200000, "sum_construction": 100000,
    "con_construct": 100000, "sum_fee": 0, "con_fee": 50000, "sum_agency": 0,
    "etc_purchase": 50000, "opportunity_id": 10, "sum_remain": 230000,
    "total_qty_delivered_amount": 7500, "total_dol_quantity_amount": 30000,
    "product_value": 7500, "total_dol_amount_all": 21000, "total_so_delivered_amount": 7500,
    "total_so_price_amount": 24000, "product_value2": -192500, "sum_po_account": 200000,
    "total_cost": 357500, "profit": 442500, "profit_rate": "55.3", "total_cost2": 157500,
    "profit2": 642500, "profit_rate2": "80.3",
}
SECOND = {
    "id": 3, "doc_id": "D-3", "doc_name": "n3", "team": "TeamA", "user": "E1",
    "expected_sale": None, "occurred_sale": 0, "uncollected_sale": 0, "gain": -70000,
    "remain_sale": 0, "biz_done": False, "biz_note": "x", "purchase_total": 70000,
    "sum_product": 0, "sum_construction": 0, "con_construct": None, "sum_fee": 0,
    "con_fee": None, "sum_agency": 70000, "etc_purchase": 0, "opportunity_id": None,
    "sum_remain": 0, "total_qty_delivered_amount": 0, "total_dol_quantity_amount": 0,
    "product_value": 0, "total_dol_amount_all": None, "total_so_delivered_amount": 0,
    "total_so_price_amount": 0, "product_value2": 0, "sum_po_account": 0, "total_cost": 70000,
    "profit": -70000, "profit_rate": None, "total_cost2": 70000, "profit2": -70000,
    "profit_rate2": None,
}


def plain(row):
    """A result row with decimals as numbers, rates as texts."""
    return {
        name: (str(value) if "rate" in name else int(value)) if isinstance(value, Decimal) else value
        for name, value in row.asDict().items()
    }


def result(tables, date=GOLDEN_DATE):
    return [plain(row) for row in pnl.contract_pnl(tables, date).collect()]


def only(tables, contract=1):
    rows = [row for row in result(tables) if row["id"] == contract]
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(params=["broadcast", "shuffled"])
def any_size(request, monkeypatch):
    """Runs a test with selections counted as small, and again with none of them small."""
    if request.param == "shuffled":
        monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)


def test_golden_case(erp, any_size):
    frame = pnl.contract_pnl(erp(), "2026-07-10")
    assert tuple(frame.columns) == pnl.PNL_COLUMNS
    assert [plain(row) for row in frame.collect()] == [FIRST, SECOND]


def test_golden_case_over_all_dates(erp, any_size):
    rows = all_dates.contract_pnl_all_dates(erp()).orderBy("date_payment", "id").collect()
    assert [(str(r.date_payment), r.id) for r in rows] == [
        ("2026-06-10", 1), ("2026-06-10", 4), ("2026-07-10", 1), ("2026-07-10", 3)
    ]
    assert [plain(r) for r in rows[2:]] == [
        {"date_payment": GOLDEN_DATE, **FIRST}, {"date_payment": GOLDEN_DATE, **SECOND}
    ]


def test_date_without_purchases(erp, any_size):
    assert result(erp(), day("2050-01-03")) == []
    empty = erp({name: [] for name in GOLDEN})
    assert result(empty) == []
    assert all_dates.contract_pnl_all_dates(empty).collect() == []


def test_undated_line_is_newest_even_without_price(erp):
    lines = [*GOLDEN["purchase_order_line"], (5, 7, None, "purchase", None, None, None)]
    prices = pnl.latest_purchase_price(erp({"purchase_order_line": lines})["purchase_order_line"])
    assert {r.product_id: r.price_unit for r in prices.collect()}[7] is None


def test_fractions_are_summed_exactly(spark, erp):
    tables = erp()
    cents = {
        "revenue_sale": ("price", "amount_collected", "amount_remain"),
        "revenue_purchase": ("price", "amount_payment", "amount_remain"),
        "approval_approval_contract": ("cost_thr", "cost_for"),
    }
    for name, columns in cents.items():
        tables[name] = tables[name].withColumns(
            {c: (F.col(c) + F.lit(Decimal("0.45"))).cast("decimal(17,2)") for c in columns}
        )
    (sold,) = pnl.sale_sums(tables["revenue_sale"]).collect()
    assert sold.total_sale == Decimal("800000.45")
    bought = {r.id: r for r in pnl.purchase_sums(tables["revenue_purchase"], GOLDEN_DATE).collect()}
    assert bought[1].purchase_total == Decimal("350001.35")
    untaxed = tables["approval_approval_contract"].withColumn("amount_type", F.lit("none"))
    kept = pnl.contract_terms(untaxed, tables["approval_approval"]).where("id = 1").collect()
    assert [r.con_construct for r in kept] == [Decimal("110000.45")]
    (row,) = pnl.contract_pnl(tables, GOLDEN_DATE).where("id = 1").collect()
    assert row.occurred_sale == Decimal("800000.45")
    assert row.purchase_total == Decimal("350001.35")
    assert row.etc_purchase == Decimal("50000.45")
    assert row.gain == row.occurred_sale * 0 + Decimal("300000.45") - (
        Decimal("120001.35") + Decimal("230000.90")
    )
    (dated,) = all_dates.contract_pnl_all_dates(tables).where(
        (F.col("id") == 1) & (F.col("date_payment") == F.lit(GOLDEN_DATE))
    ).collect()
    assert {k: v for k, v in dated.asDict().items() if k != "date_payment"} == row.asDict()


def test_ties_go_to_the_larger_id(spark):
    same = clock("2026-01-01")
    rows = spark.createDataFrame(
        [(1, 1, same, "a"), (3, 1, same, "c"), (2, 1, same, "b")],
        "id long, k long, at timestamp_ntz, v string",
    )
    assert latest_by(rows, "k", "at", "id", "v").collect()[0].v == "c"


@pytest.mark.parametrize(
    ("profit", "sold", "rate"),
    [(1, 2000, "0.1"), (-1, 2000, "-0.1"), (1, 3, "33.3"), (2, 3, "66.7"), (5, 0, None)],
)
def test_rate_rounds_half_away_from_zero(spark, profit, sold, rate):
    row = spark.range(1).select(
        rules.percent_of(F.lit(Decimal(profit)), F.lit(Decimal(sold))).cast("decimal(18,1)")
    ).collect()[0][0]
    assert (None if row is None else str(row)) == rate


def test_vat_only_off_costs_marked_as_including_it(erp):
    tables = erp({"approval_approval_contract": [(1, "tax_exclude", 110000, 55000), (3, None, 7, 8)]})
    rows = {row["id"]: row for row in result(tables)}
    assert (rows[1]["con_construct"], rows[1]["con_fee"]) == (110000, 55000)
    assert (rows[3]["con_construct"], rows[3]["con_fee"]) == (7, 8)
    assert rows[1]["expected_sale"] == 1000000


def test_terms_repeat_a_contract_but_not_its_sums(erp, any_size):
    tables = erp(extend={"approval_approval_contract": [(1, "tax_exclude", 1, 2)]})
    rows = [row for row in result(tables) if row["id"] == 1]
    assert sorted(row["con_construct"] for row in rows) == [1, 100000]
    assert {row["purchase_total"] for row in rows} == {350000}


def test_live_sale_lines_repeat_a_delivery_line(erp, any_size):
    tables = erp(extend={"sale_order_line": [(4, 900, 7, 1000, None, None, "sale")]})
    row = only(tables)
    assert row["total_dol_quantity_amount"] == 10 * 1500 * 3
    assert row["total_qty_delivered_amount"] == 5 * 1500


def test_lines_count_for_their_own_opportunity(erp, any_size):
    """A line of another opportunity than its order's counts there, and only while the
    order's opportunity is chosen on the date."""
    tables = erp(
        {"approval_approval": [
            *GOLDEN["approval_approval"][:3],
            (4, "D-4", "n4", 1, "complete", 1, None, 9, False, "x", 12),
        ]},
        extend={
            "delivery_order_line": [(1004, 100, 8, 4, 12, None)],
            "revenue_purchase": [(4, GOLDEN_DATE, 9, 27, None, 0, 9)],
        },
    )
    assert only(tables, 4)["total_dol_amount_all"] == 4 * 3000
    assert only(tables, 1)["total_dol_amount_all"] == 21000
    june = result(tables, day("2026-06-10"))
    assert [r["total_dol_amount_all"] for r in june if r["id"] == 4] == [12000]
    dated = all_dates.contract_pnl_all_dates(tables)
    for date in (GOLDEN_DATE, day("2026-06-10")):
        on_date = dated.where(F.col("date_payment") == date).drop("date_payment")
        assert rows_of(on_date) == rows_of(pnl.contract_pnl(tables, date))


def test_order_opportunity_not_chosen_that_day(erp, any_size):
    """Contract 4 is alone on its date, so order 100 of contract 1's opportunity is out."""
    tables = erp(
        extend={
            "delivery_order_line": [(1004, 100, 8, 4, 12, None)],
            "revenue_purchase": [(4, day("2026-05-11"), 9, 27, None, 0, 9)],
        }
    )
    assert [r["total_dol_amount_all"] for r in result(tables, day("2026-05-11"))] == [None]
    dated = all_dates.contract_pnl_all_dates(tables).where("date_payment = '2026-05-11'")
    assert [r.total_dol_amount_all for r in dated.collect()] == [None]


def test_unknown_purchase_ok_uses_list_price(erp):
    tables = erp({"product_template": [(70, None, 999), (80, False, 3000)]})
    assert only(tables)["total_dol_amount_all"] == 10 * 999 + 2 * 3000


def test_unknown_state_is_dropped_and_unknown_category_kept(erp):
    tables = erp(extend={"sale_order_line": [(4, 900, 7, 1000, 3, 3, None)]})
    row = only(tables)
    assert row["total_so_price_amount"] == 24000
    assert row["total_qty_delivered_amount"] == 7500
    assert row["total_dol_amount_all"] == 21000


def test_product_value2_is_zero_without_sale_orders(erp):
    row = only(erp({"sale_order": []}))
    assert row["sum_po_account"] == 200000
    assert row["product_value2"] == 0


def test_unknown_factor_drops_a_sale_line(erp, any_size):
    """An unknown price drops its line from the sale-order sums; with none left they are
    NULL, so the second product value is zero."""
    tables = erp(
        {
            "product_template": [(70, False, None), (80, None, 3000)],
            "sale_order_line": [
                (1, 900, 7, 1000, 10, 4, "sale"), (2, 900, 8, None, None, 2, "sale")
            ],
        }
    )
    row = only(tables)
    assert row["total_so_price_amount"] == 0
    assert row["total_so_delivered_amount"] == 2 * 3000
    assert row["product_value2"] == 6000 - 200000
    only_unknown = erp({"product_template": [(70, False, None), (80, None, None)]})
    assert only(only_unknown)["product_value2"] == 0


def test_sums_cover_all_dates_but_remaining_covers_one(erp, any_size):
    row = [r for r in result(erp(), day("2026-06-10")) if r["id"] == 1][0]
    assert (row["purchase_total"], row["sum_remain"]) == (350000, 0)


def test_newest_purchase_line_without_order_leaves_line_open(erp, any_size):
    """The older line of 1002 has an order, but the newest one decides."""
    tables = erp(
        extend={"purchase_order_line": [(5, 8, 2000, "purchase", clock("2026-03-01"), 1002, 999)]}
    )
    row = only(tables)
    assert row["total_dol_quantity_amount"] == 30000 + 2 * 3000


def test_order_puts_missing_document_last(erp):
    contracts = [
        *GOLDEN["approval_approval"][:3],
        (5, None, "n5", 1, "draft", 1, None, 1, False, "x", None),
        (6, "A-0", "n6", 1, "draft", 3, None, 1, False, "x", None),
    ]
    tables = erp(
        {"approval_approval": contracts},
        extend={
            "hr_employee": [(3, "E3", 2)],
            "approval_subdepartment": [(2, "TeamB")],
            "revenue_purchase": [
                (5, GOLDEN_DATE, 1, 27, None, 0, 1), (6, GOLDEN_DATE, 1, 27, None, 0, 1)
            ],
        },
    )
    assert [r["doc_id"] for r in result(tables)] == ["A-0", "D-1", "D-3", None]


def test_shared_opportunity_counts_for_every_contract_but_once_per_team(erp):
    contracts = [
        GOLDEN["approval_approval"][0],
        (5, "D-5", "n5", 1, "draft", 1, None, 1100, False, "x", 10),
    ]
    tables = erp(
        {"approval_approval": contracts},
        extend={
            "revenue_purchase": [(5, GOLDEN_DATE, 1, 27, None, 0, 1)],
            "approval_approval_contract": [(1, None, 1, 1)],
        },
    )
    assert {r["product_value"] for r in result(tables)} == {7500}
    team = all_dates.pnl_by_team(tables).where(F.col("date_payment") == GOLDEN_DATE).collect()
    assert [(r.team, r.contracts, int(r.product_value), int(r.occurred_sale)) for r in team] == [
        ("TeamA", 2, 7500, 800000)
    ]
    assert int(team[0].total_cost) == 350001 + 7500


def test_sums_wider_than_stored_money(erp):
    most = 999999999999999
    tables = erp({"revenue_sale": [(1, most, most, most)] * 3})
    row = only(tables)
    assert row["occurred_sale"] == 3 * most


def test_one_date_equals_its_part_of_all_dates(mapped):
    dated = all_dates.contract_pnl_all_dates(mapped)
    on_date = dated.where(F.col("date_payment") == MAPPED_DATE).drop("date_payment")
    single = pnl.contract_pnl(mapped, MAPPED_DATE)
    assert single.count() == 15
    assert rows_of(on_date) == rows_of(single)


def test_sizes_do_not_change_results(mapped, monkeypatch):
    small = rows_of(pnl.contract_pnl(mapped, MAPPED_DATE))
    small_dates = rows_of(all_dates.pnl_by_team(mapped))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    assert rows_of(pnl.contract_pnl(mapped, MAPPED_DATE)) == small
    assert rows_of(all_dates.pnl_by_team(mapped)) == small_dates


def test_identities_hold_on_every_row(mapped):
    broken = all_dates.contract_pnl_all_dates(mapped).where(
        (
            F.col("sum_product") + F.col("sum_construction") + F.col("sum_fee")
            + F.col("sum_agency") + F.col("etc_purchase") != F.col("purchase_total")
        )
        | (F.col("profit") + F.col("total_cost") != F.col("occurred_sale"))
        | (F.col("profit2") + F.col("total_cost2") != F.col("occurred_sale"))
        | ((F.col("occurred_sale") > 0) != F.col("profit_rate").isNotNull())
    )
    assert broken.count() == 0
