"""Session settings the toolkit relies on, and where intermediate tables are written."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings that are safe to change on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewatch") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        # Recording the Python line of every column expression costs more than the small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from the session.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost together with its executor.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set(CHECKPOINT_DIR, path)
    return path


def application_dir(spark: SparkSession) -> str:
    """Where this application writes below the shared folder."""
    return f"{shared_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_path(spark: SparkSession, name: str) -> str:
    """The path of a table that later applications go on with; `discard_staged` leaves it."""
    return f"{shared_dir(spark)}/tidewatch/{name}"


def discard_staged(spark: SparkSession) -> bool:
    """Delete what this application staged. Only once no frame built on it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_open = threading.local()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this thread has staged in between, for work that repeats for months."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for name in _open.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _open.paths = outer


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage durably, so later passes neither rescan the source nor depend on the
    executors that produced it, and gives the optimizer true sizes to choose joins by.
    """
    path = shared_path(df.sparkSession, name)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
