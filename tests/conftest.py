from __future__ import annotations

import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dealmargin.session import local_session  # noqa: E402
from dealmargin.sources.schemas import ALL  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4,
        "tests",
        **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "2"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mapped(spark):
    from dealmargin.sources.tpch_mapping import mapped_tables

    return mapped_tables(spark, SMALL)


def day(text):
    return None if text is None else datetime.date.fromisoformat(text)


def clock(text):
    return None if text is None else datetime.datetime.fromisoformat(text)


GOLDEN = {
    "approval_approval": [
        (1, "D-1", "n1", 1, "complete", 1, day("2026-07-01"), 1100000, True, "x", 10),
        (2, "D-2", "n2", 1, "complete", 2, day("2026-07-01"), 5, False, "x", 11),
        (3, "D-3", "n3", 9, "draft", 1, None, None, False, "x", None),
        (4, "D-4", "n4", 1, "complete", 1, day("2026-07-01"), 9, False, "x", 12),
    ],
    "approval_doctype": [(1, "Contract")],
    "hr_employee": [(1, "E1", 1), (2, "E2", None)],
    "approval_subdepartment": [(1, "TeamA")],
    "approval_approval_contract": [(1, "tax_include", 110000, 55000)],
    "revenue_sale": [(1, 800000, 300000, 500000), (1, None, None, None)],
    "revenue_purchase": [
        (1, day("2026-07-10"), 200000, 27, 5, 0, 200000),
        (1, day("2026-06-10"), 100000, 28, None, 100000, 0),
        (1, day("2026-07-10"), 50000, 31, 0, 20000, 30000),
        (2, day("2026-07-10"), 1, 27, None, 0, 1),
        (3, day("2026-07-10"), 70000, 30, None, 70000, 0),
        (4, day("2026-06-10"), 9, 27, None, 0, 9),
    ],
    "delivery_order": [(100, "delivery", 10), (101, "return", 10)],
    "delivery_order_line": [
        (1000, 100, 7, 10, 10, None),
        (1001, 100, 7, 5, 10, "third"),
        (1002, 100, 8, 2, 10, "own"),
        (1003, 101, 7, 3, 10, None),
    ],
    "product_product": [(7, 70), (8, 80)],
    "product_template": [(70, True, 999), (80, None, 3000)],
    "purchase_order": [(500,)],
    "purchase_order_line": [
        (1, 7, 1000, "purchase", clock("2026-01-01"), None, None),
        (2, 7, 1500, "purchase", None, None, None),
        (3, 7, 9, "draft", clock("2026-06-01"), None, None),
        (4, 8, 2000, "purchase", clock("2026-02-01"), 1002, 500),
    ],
    "sale_order": [(900, 1)],
    "sale_order_line": [
        (1, 900, 7, 1000, 10, 4, "sale"),
        (2, 900, 7, 1000, 6, 1, "sale"),
        (3, 900, 8, None, 1, 1, "cancel"),
    ],
}
GOLDEN_DATE = datetime.date(2026, 7, 10)


def frame(spark, name, rows):
    """Rows as a table of the stated schema, whole numbers turned into decimals where needed."""
    schema = ALL[name]
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.fields)
    arrays = [
        pa.array(
            [
                Decimal(str(v)) if v is not None and kind.typeName() == "decimal" else v
                for v in values
            ],
            type=to_arrow_type(kind),
        )
        for kind, values in zip([f.dataType for f in schema.fields], columns, strict=True)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


@pytest.fixture(scope="session")
def erp(spark):
    """Builds the golden tables with some of them replaced or extended."""
    base = {name: frame(spark, name, rows) for name, rows in GOLDEN.items()}

    def build(replace=None, extend=None):
        changed = dict(replace or {})
        for name, rows in (extend or {}).items():
            changed[name] = [*changed.get(name, GOLDEN[name]), *rows]
        return {**base, **{name: frame(spark, name, rows) for name, rows in changed.items()}}

    return build


def rows_of(df):
    """Rows as a sorted list of plain tuples, columns by name."""
    names = sorted(df.columns)
    return sorted(tuple(repr(row[n]) for n in names) for row in df.select(*names).collect())
