"""Causal walk-forward labels, runs, change probability and its scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.numbers import is_true, rounded
from candlewick.operators.flips import flip_counts
from candlewick.operators.indicators import MIN_BARS, walk_snapshots
from candlewick.operators.regime import classify
from candlewick.operators.series import block_window, halo_blocks, running_offsets

# Instability weights and watch thresholds.
W_MIXED_OR_WANING = 0.25
W_ADX_BOUNDARY = 0.25
W_COUNT_GAP = 0.20
W_ORDER_LOST = 0.15
W_LOW_CONFIDENCE = 0.15
WATCH_P_HAT = 0.5
WATCH_INSTABILITY = 0.6

REGIMES = ("trend", "range", "mixed")
BANDS = ("lt20", "20_30", "gt30", "unknown")
STEP_BLOCK = 4096
INSUFFICIENT = "insufficient_history"



def label_steps(
    bars: DataFrame,
    keys: Sequence[str],
    lookback: int = 250,
    step: int = 1,
    start: DataFrame | None = None,
    classify_fn: Callable[[DataFrame], DataFrame] = classify,
) -> DataFrame:
    """Label every ``step``-th right-edge bar from exactly its last ``lookback`` bars.

    ``start`` optionally holds (keys, start_idx), the first bar to label. A series
    whose start does not leave ``lookback - 1`` bars before it has no labels;
    ``start_rejects`` names it. All snapshot columns stay on the result.
    """
    if step < 1:
        raise ValueError("step must be >= 1")
    labelled = classify_fn(walk_snapshots(bars, keys, lookback))
    if start is None:
        labelled = labelled.withColumn("start_idx", F.lit(lookback - 1).cast("bigint"))
    else:
        ready = start.filter(F.col("start_idx") >= lookback - 1)
        labelled = labelled.join(ready.select(*keys, "start_idx"), list(keys))
    offset = F.col("idx") - F.col("start_idx")
    return (
        labelled.filter((offset >= 0) & (offset % step == 0))
        .withColumn("pos", F.floor(offset / step))
        .drop("start_idx")
    )


def start_rejects(bars: DataFrame, keys: Sequence[str], start: DataFrame, lookback: int) -> DataFrame:
    """Series whose start leaves too little warm-up, or that have no bar at or after it."""
    known = bars.select(*keys).distinct().join(start, list(keys), "left")
    return known.select(
        *keys,
        F.when(F.col("start_idx").isNull(), "no complete bar on or after the start")
        .when(F.col("start_idx") < lookback - 1, "too few warm-up bars")
        .alias("reason"),
    ).filter(F.col("reason").isNotNull())


def collapse_runs(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge consecutive steps with equal (regime, direction), nulls equal.

    Change flags need one row of halo; run numbers are block-local totals plus
    the offset of earlier blocks; a run of any length is one partial aggregate.
    """
    keys = list(keys)
    needed = [*keys, "pos", "idx", "ts", "high", "low", "regime", "direction", "trend_waning"]
    blocks = halo_blocks(steps.select(*needed), before=1, idx="pos", size=STEP_BLOCK)
    w = block_window(keys, idx="pos")
    same = F.col("regime").eqNullSafe(F.lag("regime").over(w)) & F.col("direction").eqNullSafe(F.lag("direction").over(w))
    first = F.lag("pos").over(w).isNull()
    flagged = blocks.withColumn("_starts", F.when(first | ~same, 1).otherwise(0)).filter("core")
    totals = flagged.groupBy(*keys, "block").agg(F.sum("_starts").alias("_runs"))
    offsets = running_offsets(totals, keys, "block", ["_runs"]).select(*keys, "block", "_runs_before")
    numbered = (
        flagged.withColumn("_local", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, [*keys, "block"])
        .withColumn("run", F.col("_runs_before") + F.col("_local") - 1)
    )
    return numbered.groupBy(*keys, "run").agg(
        F.min_by("regime", "pos").alias("regime"),
        F.min_by("direction", "pos").alias("direction"),
        F.max("trend_waning").alias("trend_waning"),
        F.min("idx").alias("start_idx"),
        F.max("idx").alias("end_idx"),
        F.min_by("ts", "pos").alias("start_ts"),
        F.max_by("ts", "pos").alias("end_ts"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.count("*").alias("bar_count"),
    )


def adx_band(adx: Column) -> Column:
    return F.when(adx < 20, "lt20").when(adx <= 30, "20_30").when(adx > 30, "gt30").otherwise("unknown")


def state_bucket() -> Column:
    return F.struct(F.col("regime"), F.col("trend_waning"), adx_band(F.col("adx")).alias("adx_band"))


def bucket_number() -> Column:
    """The state bucket as one of 24 small integers."""
    regimes = sum(F.when(F.col("regime") == r, i).otherwise(0) for i, r in enumerate(REGIMES))
    bands = sum(F.when(adx_band(F.col("adx")) == b, i).otherwise(0) for i, b in enumerate(BANDS))
    return (regimes * 8 + F.col("trend_waning").cast("int") * 4 + bands).cast("int")


def regime_changed(regime_then: Column, way_then: Column, regime_now: Column, way_now: Column) -> Column:
    """The label differs, or both are trends in different directions."""
    return ~regime_then.eqNullSafe(regime_now) | ((regime_then == "trend") & ~way_then.eqNullSafe(way_now))


def instability(order_lost: Column) -> Column:
    """Weighted risk-of-flip score in [0, 1]; ``order_lost``: the step before had another order of the averages."""
    adx, slope = F.col("adx"), F.col("adx_slope")
    boundary = adx.between(20.0, 30.0)
    against = ((F.col("regime") == "trend") & (slope < 0)) | ((F.col("regime") == "range") & F.col("adx_rising"))
    parts = [
        (W_MIXED_OR_WANING, (F.col("regime") == "mixed") | F.col("trend_waning")),
        (W_ADX_BOUNDARY, is_true(boundary) | is_true(against)),
        (W_COUNT_GAP, F.abs(F.col("trend_x_count") - F.col("range_x_count")) <= 1),
        (W_ORDER_LOST, order_lost),
        (W_LOW_CONFIDENCE, F.col("confidence") < 0.5),
    ]
    total = sum(F.when(is_true(test), weight).otherwise(0.0) for weight, test in parts)
    return rounded(F.least(total, F.lit(1.0)), 3)


def _code(column: str, values: Sequence[str], none: int) -> Column:
    """A small integer per value; ``none`` for null, the number of values for all others."""
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(values)], F.when(F.col(column).isNull(), none), F.lit(len(values) + 1))


def attach_change_prob(steps: DataFrame, keys: Sequence[str], horizon: int = 5, min_n: int = 10) -> DataFrame:
    """Instability, empirical flip probability from known outcomes only, and its delayed score.

    An outcome becomes known ``horizon`` steps later. Counts come from one pass over narrow rows (``flips``) and are
    joined to their steps; ``steps`` is read twice or more: persist it or store it.
    """
    if horizon < 1 or min_n < 1:
        raise ValueError("horizon and min_n must be >= 1")
    keys = list(keys)
    codes = {
        "bucket": bucket_number(), "regime": _code("regime", REGIMES, len(REGIMES)),
        "way": _code("direction", ("", "up", "down"), 0), "order": _code("ma_perfect_order", ("", "up", "down"), 0),
    }
    counts = flip_counts(steps.select(*keys, "pos", *[v.alias(k) for k, v in codes.items()]), keys, horizon, len(REGIMES) * 8, STEP_BLOCK)
    share = lambda hits, n: F.when(F.col(n) >= min_n, rounded(F.col(hits) / F.col(n), 4))
    told = counts.select(
        *keys, F.col("pos").alias("_pos"), F.col("changed").alias("eval_changed"), "order_lost", "n_hist",
        share("hits", "n_hist").alias("p_hat"), share("then_hits", "then_n").alias("eval_p_hat"),
    )
    scored = steps.withColumn("_pos", F.col("pos").cast("long")).join(told, [*keys, "_pos"])
    outcome = F.col("eval_changed").cast("double")
    return scored.withColumns(
        {
            "instability": instability(F.col("order_lost")),
            "bucket": state_bucket(),
            "p_hat_note": F.when(F.col("p_hat").isNull(), INSUFFICIENT),
            "eval_brier": rounded(F.pow(F.col("eval_p_hat") - outcome, 2), 4),
        }
    ).drop("_pos", "order_lost")


def change_watch(scored: DataFrame, p_hat: float = WATCH_P_HAT, score: float = WATCH_INSTABILITY) -> DataFrame:
    """Steps whose flip probability or instability reaches its threshold."""
    return scored.filter(is_true(F.col("p_hat") >= p_hat) | is_true(F.col("instability") >= score))


def summarize(scored: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: counts, mean probability, Brier score, hit rate, last values."""
    keys = list(keys)
    scored_flag = F.col("eval_p_hat").isNotNull()
    body = scored.groupBy(*keys).agg(
        F.count("*").alias("step_count"),
        *[F.count_if(F.col("regime") == r).alias(f"{r}_steps") for r in REGIMES],
        rounded(F.avg("p_hat"), 4).alias("mean_p_hat"),
        F.count("p_hat").alias("p_hat_defined"),
        F.count_if(scored_flag).alias("completed_forecasts"),
        rounded(F.avg("eval_brier"), 4).alias("brier"),
        rounded(F.count_if(scored_flag & F.col("eval_changed")) / F.nullif(F.count_if(scored_flag), F.lit(0)), 4).alias("hit_rate"),
        F.max_by("p_hat", "pos").alias("last_p_hat"),
        F.max_by("instability", "pos").alias("last_instability"),
    )
    counts = F.map_filter(
        F.create_map(*[x for r in sorted(REGIMES) for x in (F.lit(r), F.col(f"{r}_steps"))]), lambda _, v: v > 0
    )
    run_counts = runs.groupBy(*keys).agg(F.count("*").alias("run_count"))
    return body.withColumn("regime_counts", counts).join(run_counts, keys, "left")


@dataclass
class WalkResult:
    steps: DataFrame
    runs: DataFrame
    summary: DataFrame


def walk_and_collapse(
    bars: DataFrame,
    keys: Sequence[str],
    lookback: int = 250,
    step: int = 1,
    start: DataFrame | None = None,
    horizon: int = 5,
    min_n: int = 10,
) -> WalkResult:
    """Labels once, persisted, feeding probability, runs and summary."""
    if lookback < MIN_BARS:
        raise ValueError(f"lookback must be >= {MIN_BARS}; got {lookback}")
    steps = label_steps(bars, keys, lookback, step, start).persist()
    scored = attach_change_prob(steps, keys, horizon, min_n)
    runs = collapse_runs(steps, keys)
    return WalkResult(scored, runs, summarize(scored, runs, keys))
