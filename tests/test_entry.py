"""The entry point on tables nobody has asked for yet, as a fresh session finds them."""

from __future__ import annotations

import __spark_entry__ as entry_point
from dealmargin.plans import contract_pnl
from dealmargin.sources.tpch_mapping import MappedTables


def test_first_use_writes_each_table_once(spark, monkeypatch):
    written = []
    original = MappedTables._write
    monkeypatch.setattr(
        MappedTables, "_write", lambda self, name: written.append(name) or original(self, name)
    )
    tables = MappedTables(spark, entry_point.ENTRY_FOLDER)
    tables.root += "-first-use"
    assert contract_pnl.contract_pnl(tables, entry_point.ENTRY_DATE).count() == 15
    assert len(written) == len(set(written))
    assert "lines" in written
