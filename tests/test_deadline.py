"""A deadline over all jobs of a statement."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from dealmargin.operators.deadline import StatementTimeout, deadline
from dealmargin.plans import contract_pnl as pnl
from tests.conftest import GOLDEN_DATE


def active(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def endless(spark):
    """Minutes of work in one stage, with chances to notice that it is no longer wanted."""
    return spark.range(0, 10**12, 1, 8).where(F.xxhash64("id") == 0)


def test_a_long_job_is_cancelled(spark):
    started = time.monotonic()
    with pytest.raises(StatementTimeout, match="allowed"), deadline(spark, 0.5):
        endless(spark).count()
    assert time.monotonic() - started < 30
    assert active(spark) == []


def test_a_pnl_call_is_stopped_with_the_jobs_of_its_threads(spark, erp):
    """The plan runs jobs of its own while it is built, some of them in other threads."""
    tables = erp()
    slow = tables["product_product"].crossJoin(endless(spark).withColumnRenamed("id", "never"))
    tables = {**tables, "product_product": slow.select("id", "product_tmpl_id")}
    with pytest.raises(StatementTimeout), deadline(spark, 1.0):
        pnl.contract_pnl(tables, GOLDEN_DATE).collect()
    assert active(spark) == []


def test_work_in_time_is_left_alone(spark, erp):
    with deadline(spark, 600):
        rows = pnl.contract_pnl(erp(), GOLDEN_DATE).collect()
    assert {r.id for r in rows} == {1, 3}
    with pytest.raises(ZeroDivisionError), deadline(spark, 600):
        raise ZeroDivisionError
    assert spark.range(5).count() == 5


def test_other_statements_are_not_cancelled(spark):
    """A job of another thread goes on while this one's deadline passes."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: spark.range(0, 5 * 10**8, 1, 2).where(F.xxhash64("id") == 0).count())
        with pytest.raises(StatementTimeout), deadline(spark, 0.3):
            endless(spark).count()
        assert other.result(timeout=300) == 0
