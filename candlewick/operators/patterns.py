"""Swing points, trendlines and the head-and-shoulders-top stage.

Swings work on series of any length. Trendlines and formations describe one
analysis window per key: give whole series through ``series.tiles`` so that each
window is bounded; a longer group is refused rather than collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.numbers import is_true
from candlewick.operators.indicators import average_range, true_range
from candlewick.operators.series import block_window, halo_blocks

# Pattern defaults.
SWING_SIDE = 3
TOUCH_ATR_SHARE = 0.15
FALLBACK_TOLERANCE = 1e-4
BREAK_SHARE = 0.001
MAX_LINES = 5


def _with_swings(bars: DataFrame, keys: Sequence[str], left: int, right: int, before: int) -> DataFrame:
    """Core rows with ``is_high``, ``is_low``, ``tr`` and ``atr``; edge bars are never swings."""
    if left < 1 or right < 1:
        raise ValueError("left and right must be >= 1")
    w = block_window(keys)
    frame = w.rowsBetween(-left, right)
    blocks = halo_blocks(bars, before=max(before, left), after=right).withColumn("tr", true_range(w))
    inside = F.count("*").over(frame) == left + right + 1
    return blocks.withColumns(
        {
            "is_high": inside & (F.col("high") >= F.max("high").over(frame)),
            "is_low": inside & (F.col("low") <= F.min("low").over(frame)),
            "atr": average_range(w),
        }
    ).filter("core")


def _pivot(kind: str, price: str, flag: str, fields: Sequence[str]) -> Column:
    return F.when(F.col(flag), F.struct(*fields, F.lit(kind).alias("kind"), F.col(price).alias("price")))


def detect_swings(bars: DataFrame, keys: Sequence[str], left: int = SWING_SIDE, right: int = SWING_SIDE) -> DataFrame:
    """One row per swing high or low; ties count and one bar may be both."""
    marked = _with_swings(bars, keys, left, right, before=0)
    found = F.array_compact(F.array(_pivot("high", "high", "is_high", ["idx", "ts"]), _pivot("low", "low", "is_low", ["idx", "ts"])))
    return marked.select(*keys, F.explode(found).alias("p")).select(*keys, "p.*")


def line_at(i0: Column, p0: Column, i1: Column, p1: Column, i: Column) -> Column:
    """Value at ``i`` of the line through (i0, p0) and (i1, p1)."""
    return F.when(i1 == i0, p0).otherwise(p0 + (p1 - p0) / (i1 - i0) * (i - i0))


def analysis_windows(
    bars: DataFrame, keys: Sequence[str], left: int = SWING_SIDE, right: int = SWING_SIDE
) -> DataFrame:
    """One row per analysis window of any length: its ordered pivots, last bar and touch tolerance."""
    marked = _with_swings(bars, keys, left, right, before=14)
    pivots = F.array_compact(F.array(_pivot("high", "high", "is_high", ["idx", "ts"]), _pivot("low", "low", "is_low", ["idx", "ts"])))
    grouped = marked.withColumn("_p", F.when(F.col("is_high") | F.col("is_low"), pivots)).groupBy(*keys).agg(
        F.count("*").alias("bar_count"),
        F.max("idx").alias("last_idx"),
        F.max_by("ts", "idx").alias("last_ts"),
        F.max_by("close", "idx").alias("last_close"),
        F.max_by("atr", "idx").alias("atr"),
        F.array_sort(F.flatten(F.collect_list("_p"))).alias("pivots"),
    )
    share = F.col("atr") * TOUCH_ATR_SHARE
    return grouped.withColumns(
        {
            "tolerance": F.when(share > 0, share).otherwise(F.abs("last_close") * FALLBACK_TOLERANCE),
            "highs": F.filter("pivots", lambda p: p["kind"] == "high"),
            "lows": F.filter("pivots", lambda p: p["kind"] == "low"),
        }
    )


def _segments(same: str, kind: str, rank: int) -> Column:
    """Lines through consecutive pivots of one kind with their touch counts."""
    points = F.col(same)

    def line(a: Column, b: Column) -> Column:
        slope = (b["price"] - a["price"]) / (b["idx"] - a["idx"])
        touched = F.filter(
            points,
            lambda p: F.abs(p["price"] - line_at(a["idx"], a["price"], b["idx"], b["price"], p["idx"])) <= F.col("tolerance"),
        )
        return F.struct(
            (-F.size(touched)).alias("order_touches"),
            (-b["idx"]).alias("order_recent"),
            F.lit(rank).alias("order_kind"),
            F.lit(kind).alias("kind"),
            a["idx"].alias("i0"),
            b["idx"].alias("i1"),
            a["ts"].alias("ts0"),
            b["ts"].alias("ts1"),
            a["price"].alias("price0"),
            b["price"].alias("price1"),
            slope.alias("slope"),
            line_at(a["idx"], a["price"], b["idx"], b["price"], F.col("last_idx")).alias("price_at_last"),
            F.size(touched).alias("touches"),
            F.col("tolerance").alias("tolerance"),
        )

    pairs = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, pairs), F.slice(points, 2, pairs), line)


def trendline_array(max_lines: int = MAX_LINES) -> Column:
    """The best lines of a window: most touches, then most recent, then highs first."""
    ranked = F.array_sort(F.concat(_segments("highs", "resistance", 0), _segments("lows", "support", 1)))
    return F.slice(ranked, 1, max_lines)


def propose_trendlines(windows: DataFrame, keys: Sequence[str], max_lines: int = MAX_LINES) -> DataFrame:
    """One row per proposed line with ``line_no`` from 0."""
    if max_lines < 1:
        raise ValueError("max_lines must be >= 1")
    lines = windows.select(*keys, "last_idx", "last_ts", F.posexplode(trendline_array(max_lines)).alias("line_no", "l"))
    return lines.select(*keys, "line_no", "last_idx", "last_ts", "l.*").drop("order_touches", "order_recent", "order_kind")


def formation(windows: DataFrame, keys: Sequence[str], break_share: float = BREAK_SHARE) -> DataFrame:
    """Head-and-shoulders-top stage of each window.

    The latest left-head-right triple of consecutive highs decides; the neckline
    joins the last lows on either side of the head.
    """
    if break_share < 0:
        raise ValueError("break_share must be >= 0")
    highs, n = F.col("highs"), F.size("highs")
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    price = lambda i: F.element_at(highs, i)["price"]
    heads = F.filter(places, lambda i: (price(i + 1) > price(i)) & (price(i + 1) > price(i + 2)))
    at = F.try_element_at(heads, F.lit(-1))
    pick = lambda i: F.try_element_at(highs, i)
    last, previous = F.try_element_at(highs, F.lit(-1)), F.try_element_at(highs, F.lit(-2))
    rising = is_true(last["price"] > previous["price"])
    shoulders = windows.withColumn("_at", at).withColumns(
        {
            "left_shoulder": F.when(F.col("_at").isNotNull(), pick(F.col("_at"))).when(rising, previous).otherwise(last),
            "head": F.when(F.col("_at").isNotNull(), pick(F.col("_at") + 1)).when(rising, last),
            "right_shoulder": F.when(F.col("_at").isNotNull(), pick(F.col("_at") + 2)),
        }
    )

    def last_low(start: str, stop: str) -> Column:
        between = F.filter("lows", lambda p: (p["idx"] > F.col(start)["idx"]) & (p["idx"] < F.col(stop)["idx"]))
        return F.try_element_at(between, F.lit(-1))

    necks = shoulders.withColumns({"_a": last_low("left_shoulder", "head"), "_b": last_low("head", "right_shoulder")})
    has_neck = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def neck(i: Column) -> Column:
        return line_at(F.col("_a.idx"), F.col("_a.price"), F.col("_b.idx"), F.col("_b.price"), i)

    measured = necks.withColumns(
        {"_neck": F.when(has_neck, neck(F.col("last_idx"))), "_height": F.when(has_neck, F.col("head.price") - neck(F.col("head.idx")))}
    )
    over_head = F.exists(
        "highs", lambda p: (p["idx"] > F.col("right_shoulder")["idx"]) & (p["price"] > F.col("head")["price"])
    )
    stage = (
        F.when(n == 0, "none")
        .when(F.col("_at").isNull() & F.col("head").isNotNull(), "head")
        .when(F.col("_at").isNull(), "left_shoulder")
        .when(~has_neck, "right_shoulder_forming")
        .when(is_true(over_head), "invalidated")
        .when(F.col("last_close") < F.col("_neck") * (1.0 - break_share), "confirmed_break")
        .otherwise("neckline_tentative")
    )
    neckline = F.struct(
        F.col("_a.idx").alias("i0"), F.col("_b.idx").alias("i1"), F.col("_a.ts").alias("ts0"), F.col("_b.ts").alias("ts1"),
        F.col("_a.price").alias("price0"), F.col("_b.price").alias("price1"), F.col("_neck").alias("price_at_last"),
    )
    return measured.select(
        *keys,
        "bar_count", "last_idx", "last_ts", "last_close",
        stage.alias("stage"),
        "left_shoulder", "head", "right_shoulder",
        F.when(has_neck, neckline).alias("neckline"),
        F.when(F.col("_height") > 0, F.col("_height")).alias("height"),
        F.when((stage == "confirmed_break") & (F.col("_height") > 0), F.col("_neck") - F.col("_height")).alias("min_target"),
    )


def analyze_windows(
    bars: DataFrame, keys: Sequence[str], left: int = SWING_SIDE, right: int = SWING_SIDE, max_lines: int = MAX_LINES, last_swings: int | None = None
) -> DataFrame:
    """One row per window: swing count, its swings (the ``last_swings`` where given), trendlines and formation."""
    windows = analysis_windows(bars, keys, left, right).persist()
    stages = formation(windows, keys)
    extras = windows.select(
        *keys,
        F.size("pivots").alias("swing_count"),
        (F.col("pivots") if last_swings is None else F.slice("pivots", F.greatest(F.size("pivots") - last_swings + 1, F.lit(1)), last_swings)).alias("swings"),
        trendline_array(max_lines).alias("trendlines"),
    )
    return stages.join(extras, list(keys))
