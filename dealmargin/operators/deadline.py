"""A deadline over everything that one statement makes Spark do."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_POLL = 0.05


class StatementTimeout(RuntimeError):
    """A statement took longer than it may; its jobs have been cancelled."""


def _running(spark: SparkSession, tag: str) -> bool:
    tagged = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)
    return not set(tagged).isdisjoint(spark.sparkContext.statusTracker().getActiveJobsIds())


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs of the block and raise StatementTimeout once it has taken so long.

    All jobs that the block starts carry a tag, those of threads too that take
    over its properties, and the small jobs a plan runs while it is built. Later
    ones are cancelled as they start, so that the block ends with an error at
    its next job; when the error leaves here, no job of the block is running.
    Work of the driver alone is not interrupted, but counts.
    """
    context = spark.sparkContext
    tag = f"deadline-{uuid.uuid4().hex}"
    ended, expired = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        expired.set()
        while not ended.is_set():
            context.cancelJobsWithTag(tag)
            ended.wait(_POLL)

    started = time.monotonic()
    watcher = threading.Thread(target=watch, name=tag, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    failure: Exception | None = None
    try:
        yield
    except Exception as error:  # also what a cancelled job raises
        failure = error
    finally:
        context.removeJobTag(tag)
        if expired.is_set():
            while _running(spark, tag):
                time.sleep(_POLL)
        ended.set()
        watcher.join()
    if expired.is_set():
        took = time.monotonic() - started
        raise StatementTimeout(f"stopped after {took:.1f} s, {seconds:g} s allowed") from failure
    if failure is not None:
        raise failure
