"""The registered queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from dealmargin.llm import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_operator_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert set(registry.ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    frame = registry.QUERIES[name](spark, SMALL)
    cursor = sql.execute(registry.ORACLES[name])
    titles = [column[0] for column in cursor.description]
    assert sorted(titles) == sorted(frame.columns)
    expected = sorted(repr([row[titles.index(c)] for c in sorted(titles)]) for row in cursor.fetchall())
    assert sorted(repr([row[c] for c in sorted(titles)]) for row in frame.collect()) == expected
