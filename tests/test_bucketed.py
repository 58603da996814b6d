"""Bucketed tables: merges, pruning, replays and failed writes."""

import pytest
from pyspark.sql import functions as F

from candlewick.sources.bucketed import BucketedTable
from candlewick.sources.tables import VERSION

SCHEMA = "id string, rank int, text string"


def contents(df):
    return {r.id: (r.rank, r.text, r[VERSION]) for r in df.collect()}


def test_versions_touch_only_their_buckets(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=8)
    assert table.version() == 0
    first = [(f"k{i}", 0, f"old {i}") for i in range(60)] + [(None, 0, "nobody")]
    assert table.upsert(spark.createDataFrame(first, SCHEMA), 1)
    again = [("k3", 1, "first"), ("k3", 2, "last"), ("k3", 2, "last"), ("new", 0, None)]
    assert table.upsert(spark.createDataFrame(again, SCHEMA), 2, ["rank"])
    assert not table.upsert(spark.createDataFrame([("k3", 9, "replayed")], SCHEMA), 2)
    want = {k: (r, t, 1) for k, r, t in first if k} | {"k3": (2, "last", 2), "new": (0, None, 2)}
    assert contents(table.rows()) == want
    held = {r.bucket: r.held for r in table.manifest().collect()}
    touched = {r[0] for r in spark.createDataFrame(again, SCHEMA).select(table.bucket(F.col("id"))).collect()}
    assert {b for b, v in held.items() if v == 2} == touched and len(touched) < len(held) == 8
    opened = table.rows_for(spark.createDataFrame([("k3",), ("absent",)], "id string"))
    assert contents(opened) == {"k3": (2, "last", 2)} and len({f.split("bucket=")[1].split("/")[0] for f in opened.inputFiles()}) <= 2
    assert contents(table.rows_for(spark.createDataFrame([("zzzz",)], "id string"))) == {}


def test_new_columns_and_a_merge_that_empties_a_bucket(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA), 1)
    table.upsert(spark.createDataFrame([("b", 2, "z", 5.0)], SCHEMA + ", score double"), 2)
    assert {r.id: r.score for r in table.rows().collect()} == {"a": None, "b": 5.0}
    table.merge(spark.createDataFrame([("a", 0, "")], SCHEMA), 3, lambda old, fresh: old.join(fresh.select("id"), "id", "left_anti"))
    assert set(contents(table.rows())) == {"b"}


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=2)
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), 1)

    def broken(old, fresh):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([("a", 2, "y")], SCHEMA), 2, broken)
    assert contents(table.rows()) == {"a": (1, "x", 1)}
    assert table.upsert(spark.createDataFrame([("a", 2, "y")], SCHEMA), 2) and contents(table.rows()) == {"a": (2, "y", 2)}


def test_texts_are_not_aggregated(spark, tmp_path, monkeypatch):
    """The plan that picks one row per key aggregates keys, ranks and row numbers alone."""
    plans, write = [], type(spark.range(1).write).parquet

    def seen(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", seen)
    BucketedTable(spark, str(tmp_path / "t"), buckets=2).upsert(spark.createDataFrame([("a", 1, "x")] * 3, SCHEMA), 1, ["rank"])
    aggregates = [line for plan in plans for line in plan.splitlines() if "Aggregate" in line and "_row" in line]
    assert aggregates and not any("text#" in line for line in aggregates), aggregates
