"""Averages and bands of many blocks at once equal the window aggregates, bit for bit, at a cost that frames do not multiply."""

from pyspark.sql import Window, functions as F

from candlewick.operators import indicators as ind
from tests.fixtures import KEYS, frame, noise


def values(df, names):
    return {(r["instrument"], r["idx"]): tuple(r[c] for c in names) for r in df.select("instrument", "idx", *names).collect()}


def test_averages_of_blocks_equal_window_aggregates(spark):
    bars = frame(spark, {"A": noise(2300, 1), "B": noise(250, 2), "C": noise(15, 3), "D": noise(230, 4)})
    # Missing closes: single ones, and a run longer than the short frames.
    gone = (F.col("instrument") == "D") & ((F.col("idx") % 7 == 3) | F.col("idx").between(60, 95))
    bars = bars.withColumn("close", F.when(~gone, F.col("close") / 3.0)).persist()
    w = Window.partitionBy(*KEYS).orderBy("idx")
    want = bars.withColumns({**{f"sma_{p}": ind.sma(F.col("close"), p, w) for p in ind.SMA_PERIODS}, **ind.band_columns(w)})
    got = ind.indicator_blocks(bars, KEYS).filter("core")
    assert values(got, ind.AVERAGE_COLUMNS) == values(want, ind.AVERAGE_COLUMNS)
    assert set(got.columns) == {*bars.columns, "block", "core", *ind.AVERAGE_COLUMNS, *ind.SHORT_COLUMNS}


def test_long_frames_are_no_window_expressions(spark):
    bars = frame(spark, {"A": noise(300, 1)}).select(*KEYS, "idx", "close")
    blocks = ind.indicator_blocks(bars, KEYS, columns=ind.AVERAGE_COLUMNS)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Exchange") == 1
    # One short frame brings windows, which use the same exchange.
    mixed = ind.indicator_blocks(frame(spark, {"A": noise(300, 1)}), KEYS, columns=("sma_20", "high_n"))
    assert mixed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert "low_n" not in mixed.columns
