"""Session helpers: the shared scratch folder and the settings a job relies on."""

from __future__ import annotations

import contextlib
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "candlewick") -> SparkSession:
    """A session for tests and benchmarks; a cluster supplies its own."""
    cores = master.partition("[")[2].rstrip("]")
    partitions = cores if cores.isdigit() else "8"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "5000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that does not have it installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # read by the driver alone, which serves it
    archive = shutil.make_archive(f"{folder}/candlewick", "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_once(df, name: str):
    """``df`` written to the shared folder and read again, where several branches read it; its shuffles are freed."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
