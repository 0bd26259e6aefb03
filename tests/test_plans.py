"""The shape of the plans: what is pushed down, split and broadcast."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from dealmargin.operators import joins
from dealmargin.operators.joins import settle, spread_join
from dealmargin.operators.latest import latest_by
from dealmargin.plans import all_dates
from dealmargin.plans import contract_pnl as pnl
from dealmargin.plans import snapshot
from dealmargin.sources import tpch_mapping
from dealmargin.sources.schemas import SNAPSHOT
from tests.conftest import SMALL, rows_of

DATE = datetime.date(1995, 12, 29)

SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Sizes at which nothing is broadcast and small partitions already count as skewed."""
    before = {key: spark.conf.get(key, None) for key in SKEW_SETTINGS}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", -1)
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def hot(spark):
    """A third of the rows under one key, a third under none, the rest spread out."""
    return spark.range(0, 120000, 1, 8).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.col("id") % 5000)
        .cast("long")
        .alias("k"),
    )


@pytest.fixture
def looked_up(spark):
    rows = spark.range(0, 50000, 1, 8).select((F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    return rows.groupBy("k").agg(F.sum("v").alias("s"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_keys_are_split(no_broadcast, hot, looked_up, how):
    joined = spread_join(hot, looked_up, ["k"], how, F.col("id"))
    plain = hot.join(looked_up, "k", how)
    name = "s" if how != "left_semi" else "k"
    counts = joined.groupBy(name).count()
    assert sorted(map(str, counts.collect())) == sorted(
        map(str, plain.groupBy(name).count().collect())
    )
    assert "skew=true" in plan_text(counts)


def test_empty_keys_are_spread(no_broadcast, hot, looked_up):
    joined = spread_join(hot, looked_up, ["k"], "left", F.col("id"))
    spread = joined.where("k IS NULL").select("id").count()
    assert spread == 40000
    exchange = re.search(r"hashpartitioning\(k#\d+L, _spread#\d+L, 8\)", plan_text(joined))
    assert exchange is not None


def test_latest_reduces_before_the_shuffle(spark, hot):
    at = F.timestamp_seconds("id").cast("timestamp_ntz")
    newest = latest_by(hot.withColumn("at", at).withColumn("v", F.col("id")), "k", "at", "id", "v")
    text = plan_text(newest)
    assert "partial_max_by" in text and "Window" not in text
    assert "SortAggregate" not in text and "Sort " not in text


def test_newest_row_of_any_times_and_ids(spark):
    """Against a sort in Python: missing, equal and far times, negative and greatest ids."""
    import datetime
    import itertools

    far = 2**63 - 1
    times = [None, datetime.datetime(1, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999),
             datetime.datetime(2026, 3, 29, 2, 30), datetime.datetime(2026, 3, 29, 2, 30, 0, 1),
             datetime.datetime(9999, 12, 31, 23, 59, 59, 999999)]
    ids = [-far - 1, -5, 0, 7, far]
    keyed = list(enumerate(itertools.combinations(itertools.product(times, ids), 2)))
    rows = [(k, t, i, f"{t} {i}") for k, pair in keyed for t, i in pair]
    frame = spark.createDataFrame(rows, "k long, at timestamp_ntz, id long, v string")
    found = {r.k: r.v for r in latest_by(frame, "k", "at", "id", "v").collect()}
    newest = lambda pair: max(pair, key=lambda p: (p[0] is None, p[0] or times[1], p[1]))
    assert found == {k: "{} {}".format(*newest(pair)) for k, pair in keyed}


def test_all_dates_read_purchases_once(mapped):
    from dealmargin.plans import all_dates

    opened = []

    class Watched(dict):
        def __getitem__(self, name):
            opened.append(name)
            return mapped[name]

    all_dates.dated_contracts(Watched())
    assert opened.count("revenue_purchase") == 1


def test_settled_rows_are_counted_and_cut_off(spark):
    kept = settle(spark.range(10).withColumn("x", F.col("id") * 2))
    assert (kept.count, kept.small) == (10, True)
    assert "Range" not in plan_text(kept.rows)
    assert sorted(r.x for r in kept.rows.collect()) == list(range(0, 20, 2))


def test_large_selections_are_not_broadcast(mapped, no_broadcast):
    text = plan_text(pnl.contract_pnl(mapped, DATE))
    assert "Broadcast" not in text and "Cartesian" not in text
    text = plan_text(all_dates.contract_pnl_all_dates(mapped))
    assert "Broadcast" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(mapped):
    text = plan_text(pnl.payment_contracts(mapped["revenue_purchase"], DATE))
    assert "EqualTo(date_payment,1995-12-29)" in text
    assert "ReadSchema: struct<contract_doc_id:bigint,date_payment:date>" in text


def test_a_date_reads_each_fact_filtered_and_unshuffled(mapped):
    """Every fact is met by a broadcast set before anything of it is shuffled."""
    text = plan_text(pnl.purchase_sums(
        mapped["revenue_purchase"], DATE, pnl.date_headers(mapped, DATE).hinted("id")
    ))
    shuffle = text.index("Exchange hashpartitioning(contract_doc_id")
    assert text.index("LeftSemi") > shuffle
    assert text.count("Exchange hashpartitioning(contract_doc_id") == 1


@pytest.mark.parametrize(
    "name", ["contract_pnl_all_dates", "pnl_by_team", "apply_role_changes", "header_detail",
             "validate_inputs", "closing_date", "grid_update_row", "last_login"],
)
def test_plans_stay_on_the_jvm_without_cross_joins(spark, name):
    text = plan_text(entry_point.queries()[name](spark, SMALL))
    for unwanted in ("Python", "Pandas", "Cartesian", "NestedLoop", "CollectLimit"):
        assert unwanted not in text


def exchanges(df):
    """The shuffles of a plan: how each deals out, and the columns that pass it."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", text)
    return [(dealt, re.findall(r"(\w+)#", columns)) for columns, dealt in found]


def write_lineitem(spark, folder, rows):
    kinds = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
    )
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/lineitem.parquet")


def test_lines_are_hashed_and_add_up_exactly(spark, tmp_path):
    at = datetime.datetime(1996, 3, 1, 5)
    write_lineitem(
        spark,
        tmp_path,
        [
            (1, 7, 3, 1, 2.5, 10.25, "R", at),
            (1, 6, 4, 1, 3.0, 20.25, "N", at + datetime.timedelta(days=1)),
            (1, 6, 4, 1, None, None, None, None),
            (1, 5, 5, 2, 1.49, -0.5, None, None),
            (2, 5, 5, 1, None, None, "R", at),
            (3, 5, 5, 1, 1.0, 0.49, "N", at),
            (3, 5, 5, 1, 1.0, 0.01, "A", at),
            (4, 5, 5, 1, 1.0, 1.0, "B", at),
            (4, 5, 5, 1, 1.0, 1.0, "N", at),
        ],
    )
    lines = tpch_mapping._lines(tpch_mapping.MappedTables(spark, str(tmp_path)))
    found = {(r.l_orderkey, r.l_linenumber): r for r in lines.collect()}
    assert len(found) == 5
    shown = {
        key: (r.partkey, r.suppkey, r.shipdate and r.shipdate.day, r.flag, r.qty, r.price, r.id)
        for key, r in found.items()
    }
    assert shown[1, 1] == (6, 3, 1, "N", 6, 31, 11)
    assert shown[1, 2] == (5, 5, None, None, 1, -1, 12)
    assert shown[2, 1] == (5, 5, 1, "R", None, None, 21)
    assert shown[3, 1] == (5, 5, 1, "A", 2, 1, 31)
    assert shown[4, 1][3] not in ("A", "N", "R", None)  # the least is B, which no table asks for
    assert "SortAggregate" not in plan_text(lines)


def test_all_dates_shuffle_texts_by_contract_only(spark, mapped, no_broadcast, monkeypatch):
    """Not by applier, of whom there are few, and not by date, which would repeat the texts."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 500_000)
    dealt = [d for d, columns in exchanges(all_dates.contract_pnl_all_dates(mapped))
             if "doc_name" in columns]
    assert dealt and all(re.match(r"hashpartitioning\(id#", d) for d in dealt)
    dealt = [d for d, columns in exchanges(all_dates.contract_pnl_all_dates(mapped))
             if "profit_rate" in columns or "total_cost" in columns]
    assert not dealt


def test_long_names_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_TEXT", 10)
    names = spark.createDataFrame([(1, "seven b"), (2, None), (3, "四")], "id long, name string")
    kept = settle(names)
    assert (kept.text, kept.light) == (10, True)
    longer = settle(names.unionByName(names.limit(1)))
    assert (longer.small, longer.light) == (True, False)


def test_repeated_contracts_on_all_dates(erp):
    """Rows of one id with several opportunities, or none, meet their own amounts."""
    again = [
        (1, "D-1", "n1", 1, "complete", 1, None, 1100000, True, "x", 10),
        (1, "D-1b", "other", 1, "complete", 1, None, 7, True, "x", 11),
        (1, "D-1c", "none", 1, "complete", 1, None, 9, True, "x", None),
        (None, "D-0", "no id", 1, "complete", 1, None, 9, True, "x", 10),
    ]
    tables = erp(extend={"approval_approval": again})
    date = datetime.date(2026, 7, 10)
    names = ["doc_id", "doc_name", "sum_remain", "total_qty_delivered_amount", "profit"]
    dated = all_dates.dated_contracts(tables).where(F.col("date_payment") == F.lit(date))
    whole = pnl.with_profit(pnl.pnl_core(pnl.payment_scope(tables, date), tables, date))
    assert rows_of(dated.select(names)) == rows_of(whole.select(names))
    assert dated.where("id = 1").count() == 4


def test_compared_states_take_four_numbers_a_contract(spark):
    rows = spark.createDataFrame([], SNAPSHOT)
    changes = snapshot.snapshot_changes(rows, rows)
    own = [columns for _, columns in exchanges(changes)]
    assert [len(columns) for columns in own] == [6]
