"""Versioned folders: whole before, whole after, one writer at a time; snapshots that follow."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from dealmargin.plans import all_dates, snapshot, users
from dealmargin.sources import versions
from dealmargin.sources.parquet_tables import ParquetTables
from dealmargin.sources.schemas import SNAPSHOT
from dealmargin.sources.versions import ConcurrentChange, VersionedFolder
from tests.conftest import GOLDEN_DATE, day, frame, rows_of

PEOPLE = [(1, "a@x.kr", "p1", "user"), (2, "b@x.kr", "p2", "admin")]


class Stopped(Exception):
    pass


def stops(*_, **__):
    raise Stopped


@pytest.fixture
def store(spark, tmp_path):
    kept = ParquetTables(spark, str(tmp_path))
    kept.save("users", frame(spark, "users", PEOPLE))
    return kept


def roles(store):
    return {r.id: r.role for r in store["users"].collect()}


def admins(spark):
    return frame(spark, "role_changes", [(1, 1, "admin"), (2, 2, "user")])


@pytest.mark.parametrize("step", ["add", "_set_aside", "_publish"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_writer_that_stops_leaves_a_whole_table(spark, store, monkeypatch, step, when):
    original = getattr(VersionedFolder, step)

    def stopping(self, *args):
        if when == "after":
            original(self, *args)
        stops()

    with monkeypatch.context() as patched:
        patched.setattr(VersionedFolder, step, stopping)
        with pytest.raises(Stopped):
            users.store_role_changes(store, admins(spark))
    done = step == "_publish" and when == "after"
    assert roles(store) == ({1: "admin", 2: "user"} if done else {1: "user", 2: "admin"})
    users.store_role_changes(store, admins(spark))
    assert roles(store) == {1: "admin", 2: "user"}


def test_a_half_written_commit_is_not_read(spark, store, monkeypatch):
    """A job that dies while the commit's text is written leaves only the file set aside."""
    folder = store.versions("users")
    with monkeypatch.context() as patched:
        patched.setattr(versions.json, "dumps", stops)
        with pytest.raises(Stopped):
            folder.commit(folder.current(), {"": "version=9-none"})
    assert folder.numbers() == [1] and roles(store) == {1: "user", 2: "admin"}


def test_the_second_of_two_writers_is_refused(spark, store):
    base = store.versions("users").current()
    first = users.apply_role_changes(store.at("users", base), admins(spark))
    second = store.at("users", base).withColumn("role", F.lit("user"))
    store.save("users", first, base)
    with pytest.raises(ConcurrentChange):
        store.save("users", second, base)
    assert roles(store) == {1: "admin", 2: "user"}
    assert store.versions("users").numbers() == [1, 2]


def test_old_versions_stay_readable_until_vacuumed(spark, store):
    table = store.versions("users")
    old = table.current()
    users.store_role_changes(store, admins(spark))
    assert {r.id: r.role for r in store.at("users", old).collect()} == {1: "user", 2: "admin"}
    assert table.vacuum(keep=2) == []
    assert table.vacuum(keep=1) == list(old.parts.values())
    assert roles(store) == {1: "admin", 2: "user"}


def test_plain_folders_and_empty_tables(spark, tmp_path):
    frame(spark, "users", PEOPLE).write.parquet(str(tmp_path / "users"))
    plain = ParquetTables(spark, str(tmp_path))
    assert roles(plain) == {1: "user", 2: "admin"}
    empty = ParquetTables(spark, str(tmp_path / "other"))
    empty.save("users", frame(spark, "users", []))
    assert empty["users"].collect() == [] and empty["users"].columns == [
        "id", "email", "password", "role"
    ]
    missing = VersionedFolder(spark, str(tmp_path / "nothing"))
    assert missing.current().number == 0 and missing.read(SNAPSHOT).collect() == []


# --- the snapshot follows its source -----------------------------------------------


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*") if p.is_file()}


def test_a_sync_without_changes_writes_nothing(spark, erp, tmp_path):
    path = tmp_path / "snapshot"
    rows = snapshot.snapshot_rows(all_dates.contract_pnl_all_dates(erp()))
    first = snapshot.sync_snapshot(rows, str(path))
    assert (first.version.number, first.removed) == (1, [])
    assert first.written == [day("2026-06-10"), GOLDEN_DATE]
    before = files(path)
    again = snapshot.sync_snapshot(rows, str(path))
    assert (again.version.number, again.written, again.removed) == (1, [], [])
    assert files(path) == before


def test_a_changed_purchase_rewrites_its_dates_only(spark, erp, tmp_path):
    """Contract 4 has a purchase in June only; contract 1's other date keeps its files."""
    path = str(tmp_path / "snapshot")
    pnl = all_dates.contract_pnl_all_dates
    snapshot.sync_snapshot(snapshot.snapshot_rows(pnl(erp())), path)
    before = VersionedFolder(spark, path).current()
    bought = [
        (1, day("2026-07-10"), 200000, 27, 5, 0, 200000),
        (1, day("2026-06-10"), 100000, 28, None, 100000, 0),
        (1, day("2026-07-10"), 50000, 31, 0, 20000, 30000),
        (2, day("2026-07-10"), 1, 27, None, 0, 1),
        (3, day("2026-07-10"), 70000, 30, None, 70000, 0),
        (4, day("2026-06-10"), 9999, 27, None, 0, 9),
    ]
    rows = snapshot.snapshot_rows(pnl(erp({"revenue_purchase": bought})))
    done = snapshot.sync_snapshot(rows, path)
    assert (done.written, done.removed) == ([day("2026-06-10")], [])
    july = f"criteria_date={GOLDEN_DATE}"
    assert done.version.parts[july] == before.parts[july]
    assert rows_of(snapshot.read_snapshot(spark, path)) == rows_of(rows)
    one = snapshot.read_snapshot(spark, path, GOLDEN_DATE)
    assert rows_of(one) == rows_of(rows.where(F.col("criteria_date") == GOLDEN_DATE))
    assert all(july in name or before.parts[july] in name for name in one.inputFiles())


def test_a_vanished_date_is_gone(spark, erp, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = snapshot.snapshot_rows(all_dates.contract_pnl_all_dates(erp()))
    snapshot.sync_snapshot(rows, path)
    july = rows.where(F.col("criteria_date") == GOLDEN_DATE)
    done = snapshot.sync_snapshot(july, path)
    assert (done.written, done.removed) == ([], [day("2026-06-10")])
    assert rows_of(snapshot.read_snapshot(spark, path)) == rows_of(july)
    done = snapshot.sync_snapshot(july.limit(0), path)
    assert done.removed == [GOLDEN_DATE]
    assert snapshot.read_snapshot(spark, path).collect() == []


def state(spark, *rows):
    """Snapshot rows of a document, an amount, a note and a date."""
    short = spark.createDataFrame(rows, "doc_id string, n int, note string, day date")
    values = {"doc_id": F.col("doc_id"), "biz_note": F.col("note"), "criteria_date": F.col("day")}
    return short.select(
        *[values.get(f.name, F.col("n")).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields]
    )


def test_changes_are_told_apart(spark):
    """Repeated rows count, NULL differs from empty, contracts without a document id compare."""
    first, second = datetime.date(2026, 1, 1), datetime.date(2026, 1, 2)
    stored = state(
        spark, ("A", 1, "x", first), ("B", 1, None, first), ("C", 1, "x", first),
        ("D", 1, "x", first), (None, 1, "x", first), ("F", 1, "x", first), ("F", 2, "x", first),
    )
    rows = state(
        spark, ("A", 1, "x", first), ("B", 1, "", first), ("C", 1, "x", second),
        ("D", 1, "x", first), ("D", 1, "x", first), (None, 1, "x", first),
        ("F", 2, "x", first), ("F", 1, "x", first),
    )
    found = snapshot.snapshot_changes(stored, rows).collect()
    assert {(r.doc_id, r.criteria_date): r.change for r in found} == {
        ("B", first): "changed", ("C", first): "removed", ("C", second): "added",
        ("D", first): "changed",
    }
    assert snapshot.snapshot_changes(stored, stored).collect() == []
