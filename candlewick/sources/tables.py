"""Stored tables: upsert by id, additive schemas, append, versioned folders, JSON out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Column that versions carry.
VERSION = "_version"


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns only one side has read null on the other."""
    return old.unionByName(new, allowMissingColumns=True)


def one_per_id(rows: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """The row of each id that is last by ``order``, and by a hash of its values where that ties."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order, F.xxhash64(*rows.columns)))
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """New rows, one per id, replace old rows of the same id; other old rows stay, including stale tails."""
    return evolve(old.join(new.select(key), key, "left_anti"), one_per_id(new, key, order))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write one immutable version; readers of earlier versions are not disturbed."""
    path = f"{root.rstrip('/')}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def upsert_version(new: DataFrame, root: str, version: int, key: str = "id", order: Sequence[str] = ()) -> str:
    """Add version ``version``: its rows alone are written, one per id; nothing older is read or rewritten."""
    return write_version(one_per_id(new, key, order).withColumn(VERSION, F.lit(version)), root, version)


def latest_rows(spark: SparkSession, root: str, key: str = "id") -> DataFrame:
    """Every id's row of its latest version; columns that a version lacks read null."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/v*")
    return one_per_id(rows, key, [VERSION])


def compact(spark: SparkSession, root: str, target: str, key: str = "id") -> str:
    """Write the latest rows as version 1 of a new folder, apart from any ingest."""
    return write_version(latest_rows(spark, root, key).withColumn(VERSION, F.lit(1)), target, 1)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
