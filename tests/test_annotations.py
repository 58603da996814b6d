"""Texts of annotations, and the same texts by SQL."""

import duckdb
from pyspark.sql import functions as F

from candlewick.operators.annotations import walk_annotations
from tests.fixtures import KEYS

STEPS = "instrument string, granularity string, idx bigint, ts timestamp, high double, p_hat double, instability double"


def test_watch_texts_print_two_digits_of_the_double(spark):
    """Values whose third digit is a five lie above or below it as doubles; SQL and Python print the same."""
    values = [i / 1000 for i in range(5, 1000, 10)] + [0.125, 0.375, 0.625, 1.0, 0.9999, 0.0]
    steps = spark.createDataFrame([("a", "H1", i, None, 1.0, v, 0.6) for i, v in enumerate(values)] + [("a", "H1", -1, None, 1.0, None, 0.6)], STEPS)
    steps = steps.withColumn("ts", F.timestamp_seconds(F.col("idx") + 10))
    summary = spark.createDataFrame([], "instrument string, granularity string, regime_counts map<string,bigint>, step_count bigint, run_count bigint, last_p_hat double, brier double")
    got = {r.name: r.text for r in walk_annotations(None, steps, summary, KEYS, show="markers").filter("type = 'text'").collect()}
    want = {f"walk.watch.{i}.text": f"p={v:.2f}  i=0.60" for i, v in enumerate(values)}
    assert got == want | {"walk.watch.-1.text": "p=na  i=0.60"}
    printed = duckdb.execute("SELECT printf('%.2f', v) FROM (SELECT unnest(?) AS v)", [values]).fetchall()
    assert [r[0] for r in printed] == [f"{v:.2f}" for v in values]
