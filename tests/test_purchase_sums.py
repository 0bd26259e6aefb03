"""Stored purchase sums: all dates after a delta equal the full run, without reading the fact."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from dealmargin.plans import all_dates
from dealmargin.plans.purchase_sums import PurchaseSums, sums_by_date
from dealmargin.sources.versions import ConcurrentChange
from tests.conftest import day, frame, rows_of

FIRST = [
    (1, day("2026-07-10"), 200000, 27, 5, 0, 200000),
    (1, day("2026-06-10"), 100000, 28, None, 100000, 0),
    (2, day("2026-07-10"), 1, 27, None, 0, 1),
    (3, None, 70000, 30, None, 70000, 0),
    (None, day("2026-07-10"), 5, 27, None, 0, 5),
]
LATER = [
    (1, day("2026-07-10"), 50000, 31, 0, 20000, 30000),
    (3, day("2026-07-10"), None, 30, None, None, None),
    (4, day("2026-06-10"), 9, 27, None, 0, 9),
]


@pytest.fixture
def sums(spark, tmp_path):
    kept = PurchaseSums(spark, str(tmp_path / "sums"))
    kept.rebuild(frame(spark, "revenue_purchase", FIRST))
    return kept


class Watched(dict):
    """Tables that tell which of them were asked for."""

    def __init__(self, tables):
        super().__init__(tables)
        self.opened = []

    def __getitem__(self, name):
        self.opened.append(name)
        return super().__getitem__(name)


def test_all_dates_after_a_delta_equal_the_full_run(spark, erp, sums):
    sums.apply(frame(spark, "revenue_purchase", LATER))
    full = erp({"revenue_purchase": [*FIRST, *LATER]})
    tables = Watched(full)
    stored = sums.by_date()
    assert rows_of(stored) == rows_of(sums_by_date(full["revenue_purchase"]))
    for query in (all_dates.contract_pnl_all_dates, all_dates.pnl_by_team):
        assert rows_of(query(tables, stored)) == rows_of(query(full))
    assert "revenue_purchase" not in tables.opened and "revenue_sale" in tables.opened


def test_removed_and_changed_purchases(spark, sums):
    """A purchase that goes takes its contract off the date if it was the last one there."""
    gone, changed = FIRST[2], FIRST[1]
    new = (*changed[:2], 123, *changed[3:])
    sums.apply(
        frame(spark, "revenue_purchase", [new]), frame(spark, "revenue_purchase", [gone, changed])
    )
    now = frame(spark, "revenue_purchase", [FIRST[0], new, FIRST[3], FIRST[4]])
    assert rows_of(sums.by_date()) == rows_of(sums_by_date(now))
    sums.compact()
    assert rows_of(sums.by_date()) == rows_of(sums_by_date(now))
    assert len(sums.version().parts) == 1


def test_a_delta_counts_once(spark, sums):
    base, delta = sums.version(), frame(spark, "revenue_purchase", LATER)
    sums.apply(delta, base=base)
    with pytest.raises(ConcurrentChange):
        sums.apply(delta, base=base)
    full = frame(spark, "revenue_purchase", [*FIRST, *LATER])
    assert rows_of(sums.by_date()) == rows_of(sums_by_date(full))


def test_amounts_with_decimals(spark, tmp_path):
    rows = frame(spark, "revenue_purchase", FIRST).withColumns(
        {c: (F.col(c) / 8).cast("decimal(15,3)") for c in ("price", "amount_payment", "amount_remain")}
    )
    kept = PurchaseSums(spark, str(tmp_path / "sums"), scale=3)
    kept.rebuild(rows.limit(0))
    assert kept.by_date().collect() == []
    kept.apply(rows.where("contract_doc_id = 1"))
    kept.apply(rows.where("contract_doc_id <> 1 OR contract_doc_id IS NULL"))
    found = {(r.id, r.date_payment): r.purchase_total for r in kept.by_date().collect()}
    assert found[1, day("2026-07-10")] == Decimal("25000.000")
    assert found == {(r.id, r.date_payment): r.purchase_total for r in sums_by_date(rows).collect()}


def test_the_plan_of_the_registered_query_reads_no_purchases(spark, mapped):
    stored = entry_point._sums_after_deltas(mapped)
    frame_ = all_dates.contract_pnl_all_dates(mapped, stored)
    text = frame_._jdf.queryExecution().executedPlan().toString()
    assert "revenue_purchase" not in text
    assert not [name for name in stored.inputFiles() if "revenue_purchase" in name]
