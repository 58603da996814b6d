"""A keyed table in hash buckets: versions rewrite only the buckets they touch, readers open only those they need.

``root/data/version=V/bucket=B`` holds the whole bucket B as of version V; ``root/manifest/version=V`` lists,
one row per bucket, which version holds it now, its rows and its least and greatest key. A version is
there once its manifest is written, last and at once: a job that dies before leaves files that nothing
lists, and a version that is applied again does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlewick.session import stored_once
from candlewick.sources.tables import VERSION, evolve

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """One row per ``key``. Choose ``buckets`` so that one is about a GB: a touched bucket is rewritten whole."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows by bucket: Spark deals them out by the hash that numbers the buckets, and joins on the key leave them there."""
        return df.repartition(self.buckets, self.key)

    def version(self) -> int:
        """The newest version; 0 for a table without one."""
        try:
            return self.spark.read.parquet(f"{self.root}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            return 0

    def manifest(self) -> DataFrame:
        """(bucket, held, rows, least, greatest) of the newest version; ``held`` is the version whose files have the bucket."""
        return self.spark.read.parquet(f"{self.root}/manifest/version={self.version()}")

    def _read(self, entries: list) -> DataFrame:
        paths = [f"{self.root}/data/version={e['held']}/bucket={e['bucket']}" for e in entries if e["rows"]]
        if not paths:
            entries = self.manifest().filter("rows > 0").limit(1).collect()
            return self._read(entries).limit(0) if entries else self.spark.createDataFrame([], "`" + self.key + "` string, " + VERSION + " int")
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def rows(self) -> DataFrame:
        """All rows of the newest version."""
        return self._read(self.manifest().collect())

    def rows_for(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in ``keys``: of the files, only buckets that can hold one are opened.

        At most ``buckets`` rows reach the driver. A bucket is left out by its hash, or because
        its least and greatest key lie beyond the wanted ones.
        """
        wanted = keys.select(self.key)
        spans = wanted.groupBy(self.bucket(F.col(self.key)).alias("bucket")).agg(F.min(self.key).alias("_from"), F.max(self.key).alias("_to"))
        entries = self.manifest().join(spans, "bucket").filter((F.col("_to") >= F.col("least")) & (F.col("_from") <= F.col("greatest"))).collect()
        return self._read(entries).join(wanted, self.key, "left_semi")

    def upsert(self, new: DataFrame, version: int, order: Sequence[str] = ()) -> bool:
        """New rows replace those of the same key; of several new rows of a key, the last by ``order`` counts."""
        return self._merge(new, version, lambda old, fresh: evolve(self._dealt(old).join(fresh.select(self.key), self.key, "left_anti"), fresh), order)

    def merge(self, new: DataFrame, version: int, how: Merge, order: Sequence[str] = ()) -> bool:
        """``how(old, fresh)`` becomes the content of all buckets that ``new`` touches; false if ``version`` was applied before.

        ``fresh`` has one row per key, ``old`` all rows of the touched buckets. Rows
        without a key are not stored. Only keys, ``order`` and row numbers are aggregated; the other columns are joined back.
        """
        return self._merge(new, version, lambda old, fresh: self._dealt(how(old, fresh)), order)

    def _merge(self, new: DataFrame, version: int, how: Merge, order: Sequence[str]) -> bool:
        """``merge`` for a ``how`` whose rows lie in their buckets' tasks: new and old rows travel once each."""
        current = self.version()
        if version <= current:
            return False
        told = {"_hash": F.xxhash64(*new.columns), "_row": F.monotonically_increasing_id()}
        staged = stored_once(new.filter(F.col(self.key).isNotNull()).withColumns(told), "staged")
        rank = F.struct(*order, "_hash", "_row")
        last = staged.groupBy(self.key).agg(F.max(rank).alias("_last")).select(self.key, F.col("_last._row").alias("_row"))
        last = last.withColumnRenamed("_row", "_kept")
        fresh = self._dealt(staged.drop("_hash")).join(last, self.key).filter("_row = _kept").drop("_row", "_kept").withColumn(VERSION, F.lit(version))
        touched = {r[0] for r in staged.select(self.bucket(F.col(self.key))).distinct().collect()}
        before = self.manifest().collect() if current else []
        held = [e for e in before if e["bucket"] in touched]
        old = self._read(held) if any(e["rows"] for e in held) else fresh.limit(0)
        placed = how(old, fresh).withColumn("bucket", self.bucket(F.col(self.key)))
        target = f"{self.root}/data/version={version}"
        placed.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(target)
        written = []
        if touched:
            kept = self.spark.read.schema(placed.schema).parquet(target).groupBy("bucket")
            written = kept.agg(F.count("*").alias("rows"), F.min(self.key).alias("least"), F.max(self.key).alias("greatest")).collect()
        entries = [tuple(e) for e in before if e["bucket"] not in touched] + [(e["bucket"], version, e["rows"], e["least"], e["greatest"]) for e in written]
        kind = new.schema[self.key].dataType.simpleString()
        self.spark.createDataFrame(entries, f"bucket int, held int, rows long, least {kind}, greatest {kind}").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/version={version}")
        return True
