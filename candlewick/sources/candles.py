"""Bars from candle payloads, stored pages and raw events; cleaning and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.numbers import is_true
from candlewick.functions.text import strip
from candlewick.functions.times import bar_start, instant_key, parse_instant
from candlewick.operators.series import bucket, dealt

PRICE = "struct<o:string,h:string,l:string,c:string>"
CANDLE_SCHEMA = (
    f"candles array<struct<time:string,complete:boolean,volume:bigint,mid:{PRICE},bid:{PRICE},ask:{PRICE}>>"
)
DEFAULT_COUNT = 100


def parse_payloads(payloads: DataFrame, text: str, carry: Sequence[str], prefer: str = "mid") -> DataFrame:
    """JSON candle payloads to bars; the first present of preferred, mid, bid, ask wins."""
    candle = F.from_json(F.col(text), CANDLE_SCHEMA)["candles"]
    rows = payloads.select(*carry, F.posexplode(candle).alias("page_pos", "c"))
    part = F.coalesce(F.col("c")[prefer], F.col("c.mid"), F.col("c.bid"), F.col("c.ask"))
    return (
        rows.withColumn("_p", part)
        .filter(F.col("_p").isNotNull())
        .select(
            *carry,
            "page_pos",
            F.col("c.time").alias("time"),
            parse_instant(F.col("c.time")).alias("ts"),
            *[F.col("_p")[k].cast("double").alias(n) for k, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
            F.col("c.volume").alias("volume"),
            F.coalesce(F.col("c.complete"), F.lit(True)).alias("complete"),
        )
    )


def event_order(ts: Column, tie: Column) -> Column:
    """(ts, tie) as one decimal, so first/last-by aggregates stay in hash aggregation."""
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return micros * F.lit("10000000000000000000").cast("decimal(20,0)") + tie.cast("decimal(19,0)")


def bars_from_ticks(
    ticks: DataFrame,
    instrument: Column,
    granularity: str,
    ts: Column,
    price: Column,
    tie: Column,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Open/high/low/close/volume per instrument and bar; equal times ordered by ``tie``.

    With ``bucket_seconds`` ticks are dealt by (instrument, span of time), which stays as ``_bucket``:
    bars lie as ``index_rows`` ranks them. That pays where a bar has few ticks.
    """
    told, place = ticks.select(instrument.alias("instrument"), ts.alias("_ts"), price.alias("price"), tie.alias("_tie")), []
    if bucket_seconds is not None:
        place = ["_bucket"]
        told = dealt(told.withColumn("_bucket", bucket(bar_start(F.col("_ts"), granularity), bucket_seconds)), "instrument", "_bucket")
    ordered = told.select(
        "instrument", bar_start(F.col("_ts"), granularity).alias("ts"), "price", event_order(F.col("_ts"), F.col("_tie")).alias("_order"), *place
    )
    return ordered.groupBy("instrument", "ts", *place).agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.count("*").alias("volume"),
    ).select(
        "instrument", F.lit(granularity).alias("granularity"), "ts", "open", "high", "low", "close", "volume",
        F.lit(True).alias("complete"), *place,
    )


def keep_complete(bars: DataFrame) -> DataFrame:
    """Bars not marked incomplete; a missing mark means complete."""
    return bars.filter(F.coalesce(F.col("complete"), F.lit(True))) if "complete" in bars.columns else bars


def keep_until(bars: DataFrame, to: Column | None) -> DataFrame:
    """Bars not after ``to``, by whole seconds; rows without a time go only when ``to`` is given."""
    return bars if to is None else bars.filter(F.unix_seconds("ts") <= F.unix_seconds(to))


def first_per_time(bars: DataFrame, keys: Sequence[str], time: str, arrival: Sequence[str]) -> DataFrame:
    """The first arrival per raw time; rows without a time are all kept.

    Untimed rows get a group each, so they never gather in one task.
    """
    solo = F.when(F.coalesce(F.col(time).cast("string"), F.lit("")) == "", F.struct(*arrival))
    w = Window.partitionBy(*keys, time, solo).orderBy(*arrival)
    return bars.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def prepare_bars(
    bars: DataFrame, keys: Sequence[str], time: str, arrival: Sequence[str], to: Column | None = None
) -> DataFrame:
    """Complete bars only, not after ``to``, one per time."""
    return first_per_time(keep_until(keep_complete(bars), to), keys, time, arrival)


def bar_problem() -> Column:
    """Why a bar is unusable; null when it is fine."""
    return F.coalesce(
        F.when(F.col("ts").isNull(), F.lit("missing time")),
        *[F.when(F.col(c).isNull(), F.lit(f"missing '{c}'")) for c in ("open", "high", "low", "close")],
        F.when(F.col("high") < F.col("low"), "high < low"),
    )


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable bars, rejected bars with ``reason``)."""
    marked = bars.withColumn("reason", bar_problem())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def merge_pages(
    pages: DataFrame, keys: Sequence[str], arrival: Sequence[str], to: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Overlapping forward pages as one series: first row per instant, up to ``to`` and ``limit``."""
    timed = pages.filter(F.coalesce(F.col("time"), F.lit("")) != "").withColumn("_key", instant_key(F.col("time")))
    if to is not None:
        timed = timed.filter(F.col("ts") <= to)
    merged = first_per_time(timed, keys, "_key", arrival).drop("_key")
    if limit is None:
        return merged
    w = Window.partitionBy(*keys).orderBy("ts")
    return merged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def latest_bars(bars: DataFrame, keys: Sequence[str], count: int, to: Column | None = None) -> DataFrame:
    """The most recent ``count`` bars ending at ``to``; the rank limit applies before the shuffle."""
    kept = bars if to is None else bars.filter(F.col("ts") <= to)
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= count).drop("_r")


def select_bars(
    bars: DataFrame, keys: Sequence[str], frm: Column | None = None, to: Column | None = None, count: int | None = None
) -> DataFrame:
    """count, from+count, to+count or from+to; nothing given means the last 100."""
    if frm is not None and to is not None and count is not None:
        raise ValueError("cannot combine from, to and count")
    if count is not None and count < 1:
        raise ValueError("count must be positive")
    if frm is None:
        if count is None and to is not None:
            return bars.filter(F.col("ts") <= to)
        return latest_bars(bars, keys, DEFAULT_COUNT if count is None else count, to)
    later = bars.filter(F.col("ts") >= frm)
    if to is not None:
        return later.filter(F.col("ts") <= to)
    if count is None:
        return later
    w = Window.partitionBy(*keys).orderBy("ts")
    return later.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= count).drop("_r")


def clean_bars(bars: DataFrame, keys: Sequence[str], to: Column | None = None, arrival: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(complete, timed, usable bars, one per time; the others with a reason).

    Of bars with one time the first by ``arrival`` stays, by its prices where nothing
    tells the order. Incomplete bars are no rejects: they come again.
    """
    order = [*arrival, *[c for c in ("open", "high", "low", "close") if c not in arrival]]
    complete = keep_complete(bars)
    good, rejects = split_valid(prepare_bars(complete.filter(F.col("ts").isNotNull()), keys, "ts", order, to))
    return good, rejects.unionByName(split_valid(complete.filter(F.col("ts").isNull()))[1])


def walk_range(bars: DataFrame, keys: Sequence[str], frm: Column, to: Column, lookback: int, arrival: Sequence[str] = ()) -> DataFrame:
    """``lookback`` warm-up bars ending at ``frm`` plus the bars up to ``to``, complete and unique before they are counted."""
    known, _ = clean_bars(bars, keys, to, arrival)
    warm = latest_bars(known, keys, lookback, frm)
    return warm.unionByName(known.filter(F.col("ts") > frm))


def source_problem(source: Column) -> Column:
    """Why a request's source name is refused; null when it is fine or left blank."""
    given = F.nullif(strip(source), F.lit(""))
    return F.when(given.isNotNull() & ~given.rlike(r"\A[A-Za-z0-9_\-]+\z"), "source must be alphanumeric, underscore, or hyphen")


def instrument_problem(instrument: Column) -> Column:
    text = strip(instrument)
    fine = F.regexp_replace(text, "_", "").rlike(r"(?U)^[\p{Alpha}\p{N}]+$") & text.contains("_")
    return F.when(~is_true(fine), "instrument must look like GBP_USD")
