from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealmargin.plans import all_dates, approvals, snapshot, users
from dealmargin.session import ScratchNotConfigured, scratch_dir
from dealmargin.sources import erp_jdbc
from dealmargin.sources.parquet_tables import ParquetTables
from dealmargin.sources.schemas import SNAPSHOT
from tests.conftest import GOLDEN_DATE, clock, day, frame


def test_completed_approvals(erp):
    tables = erp(
        {
            "approval_approval": [
                (1, "D-1", "n1", 1, "complete", 1, day("2026-07-01"), 1, True, "x", 1),
                (2, "D-2", "n2", None, "complete", 77, day("2026-07-02"), 1, True, "x", 1),
                (3, "D-3", "n3", 1, "complete", 1, day("2026-06-30"), 1, True, "x", 1),
                (4, "D-4", "n4", 1, "complete", 1, None, 1, True, "x", 1),
                (5, "D-5", "n5", 1, "draft", 1, day("2026-07-02"), 1, True, "x", 1),
                (6, "D-6", "n6", 1, "complete", 1, day("2099-01-01"), 1, True, "x", 1),
            ]
        }
    )
    rows = approvals.completed_approvals(tables, day("2026-07-01")).collect()
    assert {r.doc_id: (r.doc_type_name, r.applier_name) for r in rows} == {
        "D-1": ("Contract", "E1"), "D-2": (None, None), "D-6": ("Contract", "E1")
    }
    recent = approvals.recent_completed_approvals(tables, day("2026-07-11"), days=10)
    assert sorted(r.doc_id for r in recent.collect()) == ["D-1", "D-2", "D-6"]
    year = approvals.recent_completed_approvals(tables, day("2027-07-01"))
    assert sorted(r.doc_id for r in year.collect()) == ["D-1", "D-2", "D-6"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a@x.kr", "p1", "user"), (2, "b@x.kr", "p2", "admin"), (3, "c@x.kr", "p3", "user")]
    return frame(spark, "users", rows)


def test_user_lookups(people):
    assert users.user_by_email(people, "\t a@x.kr \n").collect()[0].password == "p1"
    assert users.user_by_email(people, "A@x.kr").collect() == []
    assert users.user_list(people).columns == ["id", "email", "role"]
    assert [r.id for r in users.user_list(people).collect()] == [1, 2, 3]
    assert [tuple(r) for r in users.user_detail(people, 2).collect()] == [(2, "b@x.kr", "admin")]
    assert users.user_detail(people, 9).collect() == []


def test_role_changes(spark, people):
    changes = frame(
        spark,
        "role_changes",
        [(1, 1, "admin"), (2, 2, "user"), (3, 2, "root"), (4, 9, "admin"), (5, 3, "admin"),
         (6, 3, "user"), (7, 1, None), (8, None, "admin"), (None, 1, "user")],
    )
    after = users.apply_role_changes(people, changes).collect()
    assert {r.id: r.role for r in after} == {1: "admin", 2: "user", 3: "user"}
    assert {r.password for r in after} == {"p1", "p2", "p3"}
    rejects = {(r.seq, r.user_id): r.reason for r in users.role_change_rejects(changes).collect()}
    assert rejects == {
        (3, 2): "role not allowed", (7, 1): "role not allowed", (8, None): "no user",
        (None, 1): "no sequence",
    }


def test_stored_role_changes_replace_the_table(spark, people, tmp_path):
    store = ParquetTables(spark, str(tmp_path))
    store.save("users", people)
    changes = frame(spark, "role_changes", [(1, 1, "admin"), (2, 9, "admin"), (3, None, "user")])
    users.store_role_changes(store, changes)
    assert {r.id: r.role for r in store["users"].collect()} == {1: "admin", 2: "admin", 3: "user"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["users"]


def test_logins(spark, people):
    history = frame(
        spark,
        "user_login_history",
        [
            (1, 1, clock("2026-01-01T10:00:00"), clock("2026-01-01T11:00:00"), None, None),
            (2, 1, clock("2026-01-02T10:00:00"), None, None, None),
            (3, 2, clock("2026-01-01T10:00:00"), None, None, None),
            (4, 2, clock("2026-01-02T10:00:00"), clock("2026-01-02T11:00:00"), None, None),
        ],
    )
    assert [(r.id, r.login_at.day) for r in users.current_logins(people, history).collect()] == [
        (1, 2)
    ]
    last = {r.id: r.last_login_at for r in users.last_login(people, history).collect()}
    assert last[2] == datetime.datetime(2026, 1, 2, 10) and last[3] is None


@pytest.fixture(scope="module")
def dated(erp):
    tables = erp(extend={"revenue_sale": [(3, 1, 0, 0)]})
    return all_dates.contract_pnl_all_dates(tables)


def test_snapshot_keeps_what_fits(dated):
    """Contract 3 sold for 1 against a cost of 70000: a rate no snapshot column holds."""
    kept = snapshot.snapshot_rows(dated)
    assert kept.schema.fieldNames() == SNAPSHOT.fieldNames()
    assert [f.dataType for f in kept.schema.fields] == [f.dataType for f in SNAPSHOT.fields]
    on_date = kept.where(F.col("criteria_date") == GOLDEN_DATE).collect()
    assert [(r.doc_id, r.profit_rate) for r in on_date] == [("D-1", Decimal("55.3"))]
    rejects = snapshot.snapshot_rejects(dated).collect()
    assert [(r.doc_id, r.reason) for r in rejects] == [("D-3", "profit_rate out of range")]


def test_snapshot_names_every_misfit(dated):
    wide = dated.where("id = 4").withColumns(
        {"doc_id": F.repeat(F.lit("x"), 51), "expected_sale": F.lit(Decimal("1" * 16))}
    )
    reasons = [r.reason for r in snapshot.snapshot_rejects(wide).collect()]
    assert reasons == ["doc_id too long; expected_sale out of range"]


def test_snapshot_write_replaces_only_its_dates(spark, dated, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = snapshot.snapshot_rows(dated)
    snapshot.write_snapshot(rows, path)
    changed = rows.where(F.col("criteria_date") == GOLDEN_DATE).withColumn("biz_note", F.lit("new"))
    snapshot.write_snapshot(changed, path)
    stored = snapshot.read_snapshot(spark, path)
    assert stored.count() == rows.count()
    found = snapshot.snapshot_by_date(stored, GOLDEN_DATE)
    assert [(r.doc_id, r.biz_note) for r in found.collect()] == [("D-1", "new")]
    june = snapshot.snapshot_by_date(stored, day("2026-06-10")).collect()
    assert [(r.doc_id, r.biz_note) for r in june] == [("D-1", "x"), ("D-4", "x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(criteria_date" in plan


def test_parquet_tables_round_trip(spark, people, tmp_path):
    store = ParquetTables(spark, str(tmp_path))
    store.save("users", people)
    assert store["users"].schema == people.schema
    assert store["users"].count() == 3


def test_erp_settings():
    with pytest.raises(erp_jdbc.ErpNotConfigured):
        erp_jdbc.ErpSettings(host="db").options()
    settings = erp_jdbc.ErpSettings(
        host="db", user="reader", dbname="erp", statement_timeout_ms=5500
    )
    options = settings.options()
    assert options["url"] == "jdbc:postgresql://db:5432/erp"
    assert options["connectTimeout"] == "5"
    assert options["queryTimeout"] == "6"
    assert options["sessionInitStatement"] == "SET statement_timeout = 5500"
    sliced = erp_jdbc.read_options(settings, "sale_order", erp_jdbc.KeyRange("id", 0, 100))
    assert (sliced["numPartitions"], sliced["partitionColumn"]) == ("5", "id")
    assert "partitionColumn" not in erp_jdbc.read_options(settings, "sale_order", None)


def test_unconfigured_erp_fails_at_first_table(spark):
    tables = erp_jdbc.ErpTables(spark, erp_jdbc.ErpSettings())
    assert "sale_order" in list(tables)
    with pytest.raises(erp_jdbc.ErpNotConfigured):
        tables["sale_order"]


def test_facts_are_sliced_or_refused(spark):
    settings = erp_jdbc.ErpSettings(host="db", user="reader", dbname="erp")
    dates = erp_jdbc.KeyRange("date_payment", day("2020-01-01"), day("2026-01-01"))
    options = erp_jdbc.read_options(settings, "revenue_purchase", dates)
    assert (options["partitionColumn"], options["lowerBound"]) == ("date_payment", "2020-01-01")
    slices = {
        "revenue_purchase": dates,
        "revenue_sale": erp_jdbc.KeyRange("contract_doc_id", 0, 1000),
        "approval_approval_contract": ["approval_id % 2 = 0", "approval_id % 2 = 1"],
    }
    tables = erp_jdbc.ErpTables(spark, settings, slices)
    with pytest.raises(erp_jdbc.UnslicedFact):
        tables["sale_order_line"]
    for name, bad in (
        ("revenue_purchase", erp_jdbc.KeyRange("nothing", 0, 9)),
        ("approval_approval", erp_jdbc.KeyRange("doc_id", 0, 9)),
        ("revenue_sale", erp_jdbc.KeyRange("contract_doc_id", 9, 9)),
        ("revenue_sale", []),
        ("revenue_sale", ["true"] * 6),
        ("no_table", ["true"]),
    ):
        with pytest.raises(ValueError):
            erp_jdbc.ErpTables(spark, settings, {name: bad})


def test_amounts_keep_their_decimals(spark):
    fields = SNAPSHOT.fields[3:4]
    rows = spark.createDataFrame([(Decimal("100.905"),)], "expected_sale decimal(20,3)")
    read = erp_jdbc.select_typed(rows, fields)
    assert read.collect()[0][0] == Decimal("100.905")
    with pytest.raises(TypeError):
        erp_jdbc.select_typed(spark.createDataFrame([(1.5,)], "expected_sale double"), fields)
    large = spark.createDataFrame([(Decimal(10) ** 16,)], "expected_sale decimal(20,0)")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        erp_jdbc.select_typed(large, fields).collect()


class _Cluster:
    class sparkContext:  # noqa: N801
        applicationId, master = "app", "yarn"

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default):
            return default


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ScratchNotConfigured):
        scratch_dir(_Cluster)
