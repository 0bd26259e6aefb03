"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_its_sql():
    assert set(entry_point.core_queries()) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry_point.core_queries()))
def test_query_equals_its_sql(spark, sql, name):
    frame = entry_point.queries()[name](spark, SMALL)
    cursor = sql.execute(entry_point.oracle_sql()[name])
    titles = [column[0] for column in cursor.description]
    assert sorted(titles) == sorted(frame.columns)
    order = sorted(titles)
    expected = sorted(repr([row[titles.index(c)] for c in order]) for row in cursor.fetchall())
    assert sorted(repr([row[c] for c in order]) for row in frame.collect()) == expected


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 15
