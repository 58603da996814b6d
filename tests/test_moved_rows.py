"""What is stored and shuffled on the way stays small beside the rows."""

import hashlib

from pyspark.sql import functions as F

from candlewick.operators import recurrences
from candlewick.operators.corpus import embed_texts
from candlewick.sources.bucketed import BucketedTable
from tests.fixtures import KEYS, frame, noise


def test_recursions_store_blocks_not_bars(spark, monkeypatch):
    """No stored table has a row per bar: blocks of bars are rows, and states are one row per block."""
    stored, counts = recurrences.stored_once, []

    def counted(df, name):
        made = stored(df, name)
        counts.append(made.count())
        return made

    monkeypatch.setattr(recurrences, "stored_once", counted)
    bars = frame(spark, {"a": noise(300), "b": noise(128, seed=2), "c": noise(1, seed=3)})
    got = recurrences.series_recursions(bars, KEYS, block=64, fanout=4)
    assert got.count() == 429 and got.filter("instrument = 'b' and adx is not null").count() == 128 - 27
    assert counts and max(counts) <= 5 + 3 + 1  # a block that holds the last bar's halo alone counts too


def test_bucketed_rows_travel_once(spark, tmp_path, monkeypatch):
    """Rows are dealt to their buckets by the exchange that joins them; none follows for the write."""
    plans, write = [], type(spark.range(1).write).parquet

    def seen(self, path, *args, **kwargs):
        if "/data/version" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", seen)
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(40)] * 2, "id string, text string"), 1)
    table.upsert(spark.createDataFrame([("k1", "new")], "id string, text string"), 2)
    assert len(plans) == 2 and not any("hashpartitioning(bucket" in p for p in plans)
    found = {r.id: r.text for r in table.rows().collect()}
    assert found == {f"k{i}": f"text {i}" for i in range(40)} | {"k1": "new"}


def test_embedded_chunks_keep_their_digest(spark, tmp_path):
    """Readers of the vector table join by the digest; no text need travel."""
    vectors = BucketedTable(spark, str(tmp_path / "v"), "digest", buckets=2)
    chunks = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, text string")
    got = {r.id: (r.embedding, r.digest) for r in embed_texts(chunks, lambda t: F.array(F.length(t).cast("double")), vectors=vectors).collect()}
    digest = hashlib.sha256(b"x").hexdigest()
    assert got == {"a": ([1.0], digest), "b": ([1.0], digest), "c": (None, None)}
