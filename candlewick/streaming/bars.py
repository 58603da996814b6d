"""Streaming bars: complete by watermark, duplicates dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.times import GRANULARITY_SECONDS
from candlewick.sources.candles import event_order


def stream_bars(
    ticks: DataFrame, instrument: Column, granularity: str, ts: Column, price: Column, tie: Column, delay: str = "10 minutes"
) -> DataFrame:
    """Bars of a tick stream in append mode: a bar appears once the watermark passes its end.

    Weeks start on Monday. Months have no fixed width: a tick opens a session that lasts to the end of its
    calendar month (of the session's time zone), so that all ticks of a month meet in one.
    """
    # Windows of a week count from a Thursday, the day of the epoch.
    shift = "4 days" if granularity == "W" else "0 seconds"
    ordered = ticks.select(
        instrument.alias("instrument"), ts.alias("tick_ts"), price.alias("price"), event_order(ts, tie).alias("_order")
    ).withWatermark("tick_ts", delay)
    if granularity == "M":
        end = F.add_months(F.date_trunc("month", "tick_ts"), 1).cast("timestamp")
        left = (F.unix_micros(end) - F.unix_micros("tick_ts") - 1) / 1e6  # ends before the next month begins
        window = F.session_window("tick_ts", F.concat(left.cast("decimal(20,6)").cast("string"), F.lit(" seconds")))
        start = F.date_trunc("month", "session_window.start")
    else:
        width = f"{GRANULARITY_SECONDS[granularity]} seconds"
        window, start = F.window("tick_ts", width, width, shift), F.col("window.start")
    bars = ordered.groupBy("instrument", window).agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.count("*").alias("volume"),
    )
    return bars.select(
        "instrument", F.lit(granularity).alias("granularity"), start.alias("ts"),
        "open", "high", "low", "close", "volume", F.lit(True).alias("complete"),
    )


def month_bars(days: DataFrame) -> DataFrame:
    """Calendar months of daily bars; a month is complete once the days have reached its end."""
    start = F.date_trunc("month", "ts")
    months = days.groupBy("instrument", start.alias("month")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    )
    reached = days.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("_reached"))
    whole = months.join(reached, F.add_months("month", 1).cast("timestamp") <= F.col("_reached"))
    return whole.select(
        "instrument", F.lit("M").alias("granularity"), F.col("month").alias("ts"), "open", "high", "low", "close", "volume", F.lit(True).alias("complete")
    )


def drop_repeats(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """First row per (instrument, ts) of a stream of possibly repeated bars."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["instrument", "ts"])
