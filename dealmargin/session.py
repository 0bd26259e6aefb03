"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local_scratch: dict[str, str] = {}


class ScratchNotConfigured(RuntimeError):
    """spark.checkpoint.dir is unset on a cluster, so there is no shared folder to write to."""


def local_session(cores: int | str = "*", app: str = "dealmargin", **conf: str) -> SparkSession:
    """A single-machine session with the settings the tests and the bench use.

    On a cluster the caller brings its own session; nothing in the library
    depends on these values except the UTC time zone of the test fixtures.
    """
    parallel = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application has written and does not need any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, one sub-folder per application.

    Only a local master may fall back to a folder of its own; a cluster
    without the setting gets an error, since executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app_id = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/dealmargin/{app_id}"
    if not spark.sparkContext.master.startswith("local"):
        raise ScratchNotConfigured("set spark.checkpoint.dir to a folder every executor can reach")
    if app_id not in _local_scratch:
        _local_scratch[app_id] = tempfile.mkdtemp(prefix="dealmargin-")
    return _local_scratch[app_id]
