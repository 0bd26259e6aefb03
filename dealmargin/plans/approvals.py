"""Finished approvals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.functions import rules
from dealmargin.functions.dates import days_before
from dealmargin.plans.contract_pnl import Tables


def completed_approvals(tables: Tables, since: datetime.date | Column) -> DataFrame:
    """Approvals finished on or after a day, with type and applier names where known."""
    since_day = since if isinstance(since, Column) else F.lit(since)
    doc_type = tables["approval_doctype"].select(
        F.col("id").alias("doc_type"), F.col("name").alias("doc_type_name")
    )
    applier = tables["hr_employee"].select(
        F.col("id").alias("applier"), F.col("name").alias("applier_name")
    )
    return (
        tables["approval_approval"]
        .where((F.col("progress") == rules.COMPLETE) & (F.col("date_complete") >= since_day))
        .join(doc_type, "doc_type", "left")
        .join(applier, "applier", "left")
        .select("name", "doc_id", "doc_type_name", "progress", "applier_name", "date_complete")
    )


def recent_completed_approvals(
    tables: Tables, as_of: datetime.date | None = None, days: int = 365
) -> DataFrame:
    """Approvals finished in the days up to as_of, which is today unless given."""
    day = as_of or datetime.date.today()
    return completed_approvals(tables, days_before(F.lit(day), days))
