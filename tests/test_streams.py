"""Streams whose rows come late, twice, or out of order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.operators.journal import EXIT_COLUMNS, resolve_pending
from candlewick.operators.walk import label_steps
from candlewick.sources.bucketed import BucketedTable
from candlewick.streaming.labels import LATE, REPEATED, UNTIMED, stream_labels
from candlewick.streaming.runs import arrivals, drain_arrivals
from candlewick.streaming.trades import stream_fills
from tests.fixtures import KEYS, frame, noise

DAY = 86_400


def test_late_untimed_and_repeated_bars_come_out_with_a_reason(spark):
    bars = frame(spark, {"A": noise(70, 1), "B": noise(36, 2)}).drop("idx").persist()
    at = F.unix_seconds("ts") / DAY - F.unix_seconds(F.lit(datetime(2024, 1, 1))) / DAY
    early = (at < 40) & (at != 20) & (at != 38)
    first = bars.filter(early).unionByName(bars.filter(at == 5)).unionByName(bars.filter(at == 6).withColumn("ts", F.lit(None).cast("timestamp")))
    clocks = bars.groupBy(*KEYS).agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"))
    rest = bars.filter(~early).unionByName(bars.filter(at == 36)).unionByName(clocks, allowMissingColumns=True)
    got = drain_arrivals(spark, [first, rest], lambda s: stream_labels(s, KEYS, 30, delay_seconds=3 * DAY), "late").persist()
    late = sorted((r.instrument, r.reason, None if r.ts is None else (r.ts - datetime(2024, 1, 1)).days) for r in got.filter("reason is not null").collect())
    # Bar 20 comes after bar 36 was labelled, bar 38 in time; bar 36 comes again; in the short series nothing is later than 35.
    assert late == sorted([("A", REPEATED, 5), ("B", REPEATED, 5), ("A", UNTIMED, None), ("B", UNTIMED, None), ("A", LATE, 20), ("B", LATE, 20), ("A", LATE, 36)])
    whole = bars.filter(at != 20)
    numbered = whole.selectExpr("*", "row_number() over (partition by instrument order by ts) - 1 as idx").persist()
    want = label_steps(numbered, KEYS, 30).select("instrument", "ts", F.col("idx").cast("long"), "regime", "adx", "confidence")
    have = got.filter("reason is null").select(*want.columns)
    assert sorted(have.collect()) == sorted(want.collect()) and want.count() == (69 - 29) + (35 - 29)


def test_fills_are_merged_once(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(f"r{i}", day + timedelta(days=i), '{"entry": %s}' % ("null" if i == 3 else i + 0.5), "{}", "{}", i) for i in range(6)]
    runs = BucketedTable(spark, str(tmp_path / "runs"), "run_id", buckets=4)
    runs.upsert(spark.createDataFrame(rows, "run_id string, ts timestamp, proposal_json string, regime_json string, risk_json string, line long"), 1)
    exits = [F.lit(None).cast(t).alias(c) for c, t in EXIT_COLUMNS.items()]
    queued = runs.rows().select("run_id", F.lit("pending").alias("status"), F.lit(None).cast("double").alias("fill_price"), "ts", F.lit("").alias("note"), *exits, F.lit(1).cast("bigint").alias("batch"), "line")
    fills = BucketedTable(spark, str(tmp_path / "fills"), "run_id", buckets=4)
    fills.upsert(queued.filter("run_id = 'r0'").withColumns({"status": F.lit("filled_sim"), "fill_price": F.lit(9.0)}), 1)
    for arrived in arrivals(spark, [queued.filter("line < 3"), queued], "fills-in"):
        stream_fills(arrived, runs.rows_for, fills, str(tmp_path / "checkpoint"), after=1).awaitTermination()
    got = {r.run_id: (r.status, r.fill_price, r._version) for r in fills.rows().collect()}
    assert got == {"r0": ("filled_sim", 9.0, 1), "r1": ("filled_sim", 1.5, 2), "r2": ("filled_sim", 2.5, 2), "r3": ("rejected", None, 3), "r4": ("filled_sim", 4.5, 3), "r5": ("filled_sim", 5.5, 3)}
    assert not fills.merge(queued, 3, lambda old, new: pytest.fail("a version is merged once"))
    assert resolve_pending(runs.rows(), queued).count() == 6
