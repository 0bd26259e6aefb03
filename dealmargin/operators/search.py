"""Declared search conditions of the lookup screens, applied as column predicates."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the select option that means no condition.
ANY = "전체"


class Field(NamedTuple):
    """A search field: its kind, its name on the form and the column it looks at."""

    kind: str
    name: str
    column: str | None


# The fields each screen declares. The voucher screen's unit and
# site have no column in the voucher data.
VOUCHERS = (
    Field("text", "unit", None),
    Field("text", "site", None),
    Field("daterange", "date_range", "acc_date"),
    Field("select", "status", "status"),
)
ACCOUNTS = (
    Field("text", "account_code", "account_code"),
    Field("text", "account_name", "account_name"),
)
VENDORS_BIZNO = (
    Field("text", "vendor_name", "vendor_name"),
    Field("text", "biz_no", "biz_no"),
)
TAX_INVOICES = (
    Field("daterange", "date_range", "issue_date"),
    Field("select", "tax_type", "tax_type"),
    Field("text", "vendor_name", "vendor_name"),
)
VENDOR_INFO = (
    Field("text", "vendor_name", "vendor_name"),
    Field("text", "vendor_code", "vendor_code"),
    Field("select", "use_yn", "use_yn"),
)


def _date_range(column: Column, text: str) -> Column:
    """YYYY/MM/DD - YYYY/MM/DD, both ends included."""
    low, high = (
        datetime.datetime.strptime(part.strip(), "%Y/%m/%d").date() for part in text.split(" - ")
    )
    return column.between(F.lit(low), F.lit(high))


def _predicate(field: Field, value: str) -> Column:
    column = F.col(field.column)
    if field.kind == "text":
        return F.lower(column).contains(F.lower(F.lit(value)))
    if field.kind == "select":
        return column == value
    if field.kind == "daterange":
        return _date_range(column, value)
    raise ValueError(f"unknown kind of search field: {field.kind}")


def apply_conditions(
    rows: DataFrame, fields: Sequence[Field], values: Mapping[str, str]
) -> DataFrame:
    """Rows meeting every filled-in field. A value no field or column takes is an error."""
    known = {field.name: field for field in fields}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"no such search field: {name}")
        field = known[name]
        if value in (None, "") or (field.kind == "select" and value == ANY):
            continue
        if field.column is None:
            raise ValueError(f"the data has no column for search field: {name}")
        rows = rows.where(_predicate(field, value))
    return rows


def search_keyword(rows: DataFrame, keyword: str) -> DataFrame:
    """The search of a screen without declared fields: the keyword in any text column."""
    texts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string"]
    if not keyword or not texts:
        return rows
    needle = F.lower(F.lit(keyword))
    hits = [F.coalesce(F.lower(name).contains(needle), F.lit(False)) for name in texts]
    return rows.where(reduce(lambda a, b: a | b, hits))


def header_detail(headers: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Headers with the number and plain amount sum of their detail rows, none counting 0."""
    sums = (
        details.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("detail_count"),
            F.sum("amount").alias("detail_amount"),
        )
    )
    total = sums.schema["detail_amount"].dataType
    return headers.join(sums, key, "left").withColumns(
        {
            "detail_count": F.coalesce("detail_count", F.lit(0)),
            "detail_amount": F.coalesce("detail_amount", F.lit(0)).cast(total),
        }
    )


def purchases_of_contract(purchases: DataFrame, contract_id: int) -> DataFrame:
    """The purchase rows of a selected contract."""
    return purchases.where(F.col("contract_doc_id") == contract_id)
