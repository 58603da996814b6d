"""Trend/range checklist over snapshot rows: pure column expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.numbers import computed_once, count_true, is_true, rounded
from candlewick.operators.indicators import last_snapshots

# Checklist thresholds.
ADX_TREND = 25.0
ADX_IDEAL_RANGE = 20.0
ADX_NEAR_PEAK = 35.0
ADX_PEAK = 40.0
RSI_HIGH, RSI_LOW = 70.0, 30.0
STOCH_HIGH, STOCH_LOW = 80.0, 20.0

# Texts of the notes list.
NOTE_RISK_REVERSALS = "risk_reversals=unavailable"
NOTE_IMPLIED_VOL = "implied_vol=unavailable"
NOTE_WANING = "trend_waning: ADX>25 but falling from a high level; do not aggress"

TREND_CHECKS = ("adx_above_25", "adx_rising", "outer_band_tag", "ma_break", "perfect_order", "oscillators_aligned")
RANGE_CHECKS = ("adx_below_25", "adx_below_20", "adx_falling", "inside_1sigma", "rsi_extreme", "stoch_extreme")


def direction() -> Column:
    """Stack order, else the larger DI, else close against SMA-20, else the band zone."""
    up_if = lambda up, down: F.when(is_true(up), "up").when(is_true(down), "down")
    pdi, mdi = F.col("plus_di"), F.col("minus_di")
    return F.coalesce(
        F.col("ma_perfect_order"),
        up_if(pdi > mdi, pdi < mdi),
        up_if(F.col("vs_sma_20") == "above", F.col("vs_sma_20") == "below"),
        up_if(F.col("bb_zone") == "trend_up", F.col("bb_zone") == "trend_down"),
    )


def oscillators_aligned(way: Column) -> Column:
    """At least two of RSI, stochastic and MACD histogram agree with the direction."""
    k, d = F.col("stoch_k"), F.col("stoch_d")
    up = count_true(F.col("rsi") > 50, (k > 50) | (k >= d), F.col("macd_hist") > 0)
    down = count_true(F.col("rsi") < 50, (k < 50) | (k <= d), F.col("macd_hist") < 0)
    return F.when(way == "up", up >= 2).when(way == "down", down >= 2).otherwise(False)


def ma_break(way: Column) -> Column:
    """Close beyond SMA-50 or SMA-100 in the direction."""
    side = F.when(way == "up", "above").when(way == "down", "below")
    return is_true(F.col("vs_sma_50") == side) | is_true(F.col("vs_sma_100") == side)


def trend_checks() -> dict[str, Column]:
    way = F.col("direction")
    return {
        "adx_above_25": is_true(F.col("adx") > ADX_TREND),
        "adx_rising": F.col("adx_rising"),
        "outer_band_tag": F.col("bb_zone").isin("trend_up", "trend_down"),
        "ma_break": ma_break(way),
        "perfect_order": F.col("ma_perfect_order").isNotNull(),
        "oscillators_aligned": oscillators_aligned(way),
    }


def range_checks() -> dict[str, Column]:
    return {
        "adx_below_25": is_true(F.col("adx") < ADX_TREND),
        "adx_below_20": is_true(F.col("adx") < ADX_IDEAL_RANGE),
        "adx_falling": is_true(F.col("adx_slope") < 0),
        "inside_1sigma": F.col("bb_zone") == "range",
        "rsi_extreme": is_true((F.col("rsi") >= RSI_HIGH) | (F.col("rsi") <= RSI_LOW)),
        "stoch_extreme": is_true((F.col("stoch_k") >= STOCH_HIGH) | (F.col("stoch_k") <= STOCH_LOW)),
    }


def trend_waning() -> Column:
    """ADX above 25 and falling, from a level near or past its peak zone."""
    adx, slope = F.col("adx"), F.col("adx_slope")
    return is_true((adx > ADX_TREND) & (slope < 0) & ((adx >= ADX_NEAR_PEAK) | (adx - slope >= ADX_PEAK)))


def regime_label() -> Column:
    """Ordered decision list over counts and ADX; waning comes first."""
    trend_n, range_n, adx = F.col("trend_x_count"), F.col("range_x_count"), F.col("adx")
    return (
        F.when(F.col("trend_waning"), "mixed")
        .when(is_true((trend_n >= 3) & (adx > ADX_TREND)), "trend")
        .when(is_true((range_n >= 3) & (adx < ADX_TREND)), "range")
        .when(is_true((F.col("bb_zone") == "range") & (adx < ADX_TREND)), "range")
        .when(is_true(F.col("bb_zone").isin("trend_up", "trend_down") & (adx > ADX_TREND)), "trend")
        .otherwise("mixed")
    )


def play_class(label: Column) -> Column:
    return F.when(label == "trend", "join_trend").when(label == "range", "fade_range").otherwise("breakout_watch")


def confidence() -> Column:
    trend_n, range_n = F.col("trend_x_count"), F.col("range_x_count")
    mixed = F.least(trend_n, range_n) / F.greatest(trend_n + range_n, F.lit(1))
    return rounded(
        F.when(F.col("regime") == "trend", trend_n / 6.0).when(F.col("regime") == "range", range_n / 6.0).otherwise(mixed), 3
    )


def notes() -> Column:
    missing = F.array_join(F.col("sma_missing").cast("array<string>"), ", ")
    return F.array_compact(
        F.array(
            F.when(F.size("sma_missing") > 0, F.concat(F.lit("sma_missing=["), missing, F.lit("]"))),
            F.lit(NOTE_RISK_REVERSALS),
            F.lit(NOTE_IMPLIED_VOL),
            F.when(F.col("trend_waning"), NOTE_WANING),
        )
    )


def classify(snapshots: DataFrame) -> DataFrame:
    """Add the checklist, regime, play class, confidence and notes to snapshot rows."""
    with_direction = snapshots.withColumn("direction", direction())
    checks = with_direction.withColumns(
        {
            "trend_checks": F.struct(*[c.alias(n) for n, c in trend_checks().items()]),
            "range_checks": F.struct(*[c.alias(n) for n, c in range_checks().items()]),
            "trend_waning": trend_waning(),
        }
    )
    counts = checks.withColumns(
        {
            "trend_x_count": count_true(*[F.col("trend_checks")[n] for n in TREND_CHECKS]),
            "range_x_count": count_true(*[F.col("range_checks")[n] for n in RANGE_CHECKS]),
        }
    )
    labelled = computed_once(counts, "regime", regime_label())
    return labelled.withColumns(
        {"allowed_play_classes": F.array(play_class(F.col("regime"))), "confidence": confidence(), "notes": notes()}
    )


def analyze_last(bars: DataFrame, keys: Sequence[str], count: int = 250) -> tuple[DataFrame, DataFrame]:
    """One classified row per series from its last ``count`` bars, and the rejected series."""
    snapshots, rejects = last_snapshots(bars, keys, count)
    return classify(snapshots), rejects
