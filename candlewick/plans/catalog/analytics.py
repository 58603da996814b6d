"""Indicators, regime labels, walks and patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from candlewick.operators import indicators as ind, patterns, recurrences, regime, walk, windows
from candlewick.operators.series import block_window, first_index, halo_blocks, tiles
from candlewick.plans.catalog.inputs import KEYS, LOOKBACK, SMA, daily, hourly, hourly_labels, hourly_ticks, out, outer, sql
from candlewick.plans.registry import query
from candlewick.plans.walkforward import walk_forward

TILE, STRIDE = 150, 50


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_SMAS = [f"sma_{p}" for p in SMA]
_BANDS = ["bb_mid", "bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2"]


def _frames(bars, columns):
    """Bounded-frame indicators of every bar, over halo blocks."""
    prices = bars.select(*KEYS, "idx", "high", "low", "close")
    blocks = ind.indicator_blocks(prices, KEYS, before=max(SMA) - 1, columns=columns)
    return out(blocks.filter("core"), "instrument", "idx", *columns)


@query("i1_i3_i5_bands_and_averages", outer("hi", f"instrument, idx, {_r(*_SMAS, *_BANDS)}"))
def bands_and_averages(spark, sf):
    return _frames(hourly(spark, sf), [*_SMAS, *_BANDS])


@query("i1_i5_supplier_bands", outer("di", f"instrument, idx, {_r(*_SMAS, *_BANDS, digits=4)}"))
def supplier_bands(spark, sf):
    closes = daily(spark, sf).select(*KEYS, "idx", "close")
    blocks = ind.indicator_blocks(closes, KEYS, before=max(SMA) - 1, columns=[*_SMAS, *_BANDS])
    return out(blocks.filter("core"), "instrument", "idx", *_SMAS, *_BANDS, digits=4)


@query("i2_i10_stochastic", outer("hi", f"instrument, idx, {_r('stoch_k', 'stoch_d')}"))
def stochastic(spark, sf):
    return _frames(hourly(spark, sf), ["stoch_k", "stoch_d"])


@query("i6_band_zone", sql("""SELECT instrument, idx, CASE WHEN bb_upper_1 IS NULL THEN 'unknown'
        WHEN bb_upper_1 - bb_lower_1 <= 1e-12 THEN 'range' WHEN close > bb_upper_1 THEN 'trend_up'
        WHEN close < bb_lower_1 THEN 'trend_down' ELSE 'range' END AS zone FROM hi""", "hi"))
def band_zone(spark, sf):
    blocks = ind.indicator_blocks(hourly(spark, sf), KEYS, before=max(SMA) - 1, columns=_BANDS).filter("core")
    zone = ind.band_zone(F.col("close"), *[F.col(c) for c in ("bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2")])
    return out(blocks.withColumn("zone", zone), "instrument", "idx", "zone")


@query("i7_i13_ranges_and_moves", outer("hi", f"instrument, idx, {_r('tr', 'plus_dm', 'minus_dm', 'high_n', 'low_n')}"))
def ranges_and_moves(spark, sf):
    return _frames(hourly(spark, sf), ["tr", "plus_dm", "minus_dm", "high_n", "low_n"])


@query("i12_stack_order", sql(f"""SELECT instrument, idx,
    CASE WHEN {' AND '.join(f'sma_{a} > sma_{b}' for a, b in zip(SMA, SMA[1:]))} THEN 'up'
        WHEN {' AND '.join(f'sma_{a} < sma_{b}' for a, b in zip(SMA, SMA[1:]))} THEN 'down' END AS stack FROM (
    SELECT instrument, idx, {', '.join(f'round_even({c}, 6) AS {c}' for c in _SMAS)} FROM hi)""", "hi"))
def stack_order(spark, sf):
    blocks = ind.indicator_blocks(hourly(spark, sf), KEYS, before=max(SMA) - 1, columns=_SMAS).filter("core")
    return out(blocks.withColumn("stack", ind.stack_order([F.bround(c, 6) for c in _SMAS])), "instrument", "idx", "stack")


_RECURSIVE = ("macd", "macd_signal", "macd_hist", "rsi", "adx", "plus_di", "minus_di", "adx_slope")


@query("i4_i8_i9_i11_walk_recursions", outer("hsnap", f"instrument, idx, {_r(*_RECURSIVE)}"))
def walk_recursions(spark, sf):
    return out(ind.walk_snapshots(hourly(spark, sf), KEYS, LOOKBACK), "instrument", "idx", *_RECURSIVE)


_WHOLE = ("ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "rsi", "plus_di", "minus_di", "adx")


@query("i4_i8_i9_i11_whole_series", outer("d_whole", """instrument, m AS idx, CASE WHEN m >= 11 THEN round(f12, 4) END AS ema_fast, CASE WHEN m >= 25 THEN round(f26, 4) END AS ema_slow,
    CASE WHEN m >= 25 THEN round(f12 - f26, 4) END AS macd, CASE WHEN m >= 33 THEN round(sig, 4) END AS macd_signal, CASE WHEN m >= 33 THEN round(f12 - f26 - sig, 4) END AS macd_hist,
    CASE WHEN m >= 14 THEN round(CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END WHEN g = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END, 4) END AS rsi,
    CASE WHEN m >= 14 THEN round(pdi, 4) END AS plus_di, CASE WHEN m >= 14 THEN round(mdi, 4) END AS minus_di, CASE WHEN m >= 27 THEN round(adx, 4) END AS adx"""))
def whole_series(spark, sf):
    """Recursions over whole supplier series, in blocks of 64 bars and a tree of fan-out 4."""
    bars = daily(spark, sf).select(*KEYS, "idx", "high", "low", "close")
    return out(recurrences.series_recursions(bars, KEYS, block=64, fanout=4), "instrument", "idx", *_WHOLE, digits=4)


_SNAP = ["last_close", *_SMAS, *_BANDS, "bb_width", "stoch_k", "stoch_d", "rsi", "adx", "plus_di", "minus_di", "adx_slope", "macd", "macd_signal", "macd_hist", "high_n", "low_n"]
_SNAP_TEXT = ["bb_zone", "ma_perfect_order", *[f"vs_sma_{p}" for p in SMA]]


@query("i14_last_snapshots", sql(f"""SELECT instrument, {LOOKBACK}::BIGINT AS bar_count, {_r(*_SNAP)}, {', '.join(_SNAP_TEXT)}, adx_rising
    FROM hsnap QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY idx DESC) = 1""", "hsnap"))
def last_snapshots(spark, sf):
    good, _ = ind.last_snapshots(hourly(spark, sf), KEYS, LOOKBACK)
    return out(good, "instrument", "bar_count", *_SNAP, *_SNAP_TEXT, "adx_rising")


@query("i14_snapshot_rejects", sql("""SELECT instrument, count(*) AS bar_count, 'need at least 30 bars; got ' || count(*) AS reason
    FROM (SELECT instrument || '/' || (ts::DATE) AS instrument FROM hb) GROUP BY 1 HAVING count(*) < 30""", "hb"))
def snapshot_rejects(spark, sf):
    """Every day as its own series: none has enough bars."""
    w = Window.partitionBy("instrument", "granularity").orderBy("idx")
    days = hourly(spark, sf).withColumn("instrument", F.concat("instrument", F.lit("/"), F.to_date("ts").cast("string")))
    return out(ind.last_snapshots(days.withColumn("idx", F.row_number().over(w) - 1), KEYS, LOOKBACK)[1], "instrument", "bar_count", "reason")


@query("i15_plot_series", sql(f"""SELECT instrument, idx, {_r(*_SMAS, 'bb_upper_2', 'bb_upper_1', 'bb_lower_1', 'bb_lower_2')} FROM hi
    QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY idx DESC) <= 80""", "hi"))
def plot_series(spark, sf):
    bars = hourly(spark, sf)
    counts = bars.groupBy(*KEYS).agg(F.count("*").alias("bar_count"))
    return out(ind.plot_series(bars, KEYS, counts), "instrument", "idx", *_SMAS, "bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2")


@query("i16_average_range", sql("""SELECT instrument, idx, round(coalesce(avg(tr) OVER (PARTITION BY instrument ORDER BY idx
    ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), high - low), 6) AS atr FROM hi""", "hi"))
def average_range(spark, sf):
    w = block_window(KEYS)
    blocks = halo_blocks(hourly(spark, sf), before=14).withColumn("tr", ind.true_range(w))
    return out(blocks.withColumn("atr", ind.average_range(w)).filter("core"), "instrument", "idx", "atr")


_LABEL = "instrument, idx, regime, direction, trend_waning, trend_n::BIGINT AS trend_x_count, range_n::BIGINT AS range_x_count, confidence, play_class"


@query("r1_r9_last_regime", sql(f"SELECT {_LABEL} FROM hlab QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY idx DESC) = 1", "hlab"))
def last_regime(spark, sf):
    good, _ = regime.analyze_last(hourly(spark, sf), KEYS, LOOKBACK)
    return out(
        good.withColumn("play_class", F.col("allowed_play_classes")[0]),
        "instrument", "idx", "regime", "direction", "trend_waning", "trend_x_count", "range_x_count", "confidence", "play_class",
    )


@query("r2_r3_r4_checks", outer("hlab", """instrument, idx, c_adx_above AS adx_above_25, adx_rising, c_outer AS outer_band_tag,
    c_break AS ma_break, c_order AS perfect_order, c_osc AS oscillators_aligned, r_below_25 AS adx_below_25, r_below_20 AS adx_below_20,
    r_falling AS adx_falling, r_inside AS inside_1sigma, r_rsi AS rsi_extreme, r_stoch AS stoch_extreme"""))
def checks(spark, sf):
    labels = hourly_labels(spark, sf)
    return out(labels.select("instrument", "idx", "trend_checks.*", "range_checks.*"))


@query("r8_notes", outer("hlab", """instrument, idx, CASE WHEN trend_waning THEN
    'risk_reversals=unavailable|implied_vol=unavailable|trend_waning: ADX>25 but falling from a high level; do not aggress'
    ELSE 'risk_reversals=unavailable|implied_vol=unavailable' END AS notes"""))
def notes(spark, sf):
    return out(hourly_labels(spark, sf).select("instrument", "idx", F.array_join("notes", "|").alias("notes")))


@query("w1_walk_labels", outer("hlab", f"{_LABEL}, epoch(ts)::BIGINT AS ts, close, ma_perfect_order, round(adx, 4) AS adx, round(adx_slope, 4) AS adx_slope"))
def walk_labels(spark, sf):
    labels = hourly_labels(spark, sf).withColumn("play_class", F.col("allowed_play_classes")[0])
    return out(
        labels, "instrument", "idx", "regime", "direction", "trend_waning", "trend_x_count", "range_x_count", "confidence",
        "play_class", "ts", "close", "ma_perfect_order", "adx", "adx_slope",
    )


@query("w1_walk_from_start", sql(f"""SELECT l.instrument, idx, (idx - s) // 3 AS pos, regime, direction, confidence FROM hlab l JOIN (
    SELECT instrument, min(idx) AS s FROM hb WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) USING (instrument)
    WHERE idx >= s AND (idx - s) % 3 = 0""", "hlab"))
def walk_from_start(spark, sf):
    """Every third bar from a start date that leaves full warm-up."""
    bars = hourly(spark, sf)
    start = first_index(bars, KEYS, F.lit("2024-01-15 00:00:00").cast("timestamp")).filter(F.col("start_idx") >= LOOKBACK - 1)
    return out(walk.label_steps(bars, KEYS, LOOKBACK, step=3, start=start), "instrument", "idx", "pos", "regime", "direction", "confidence")


@query("w1_supplier_walk_labels", outer("d_hlab", "instrument, idx, epoch(ts)::BIGINT AS ts, regime, direction, trend_waning, confidence"))
def supplier_walk_labels(spark, sf):
    """Walk over many series: daily bars of every supplier."""
    labels = walk.label_steps(daily(spark, sf), KEYS, LOOKBACK)
    return out(labels, "instrument", "idx", "ts", "regime", "direction", "trend_waning", "confidence")


# Windows whose net move is at least a third of their range trend; SQL sees the same frames.
_EFFICIENT = f"""SELECT *, idx - {LOOKBACK - 1} AS pos, CASE WHEN abs(net) >= spread / 3 THEN 'trend' ELSE 'range' END AS regime, CASE WHEN net > 0 THEN 'up' WHEN net < 0 THEN 'down' END AS direction,
    false AS trend_waning FROM (SELECT *, close - first_value(close) OVER w AS net, max(high) OVER w - min(low) OVER w AS spread, count(*) OVER w AS n
        FROM hb WINDOW w AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)) WHERE n = {LOOKBACK}"""


def efficiency(windows):
    """A record per window: its net move against its range."""
    net = windows["close"][:, -1] - windows["close"][:, 0]
    spread = windows["high"].max(axis=1) - windows["low"].min(axis=1)
    regime = np.where(np.abs(net) >= spread / 3, "trend", "range")
    direction = np.where(net > 0, "up", np.where(net < 0, "down", None))
    return {"net": net, "spread": spread, "regime": regime, "direction": direction}


def _efficient(spark, sf):
    return windows.window_records(hourly(spark, sf), KEYS, LOOKBACK, efficiency, "net double, spread double, regime string, direction string")


@query("u2_window_records", sql(f"SELECT instrument, idx, round(net, 6) AS net, round(spread, 6) AS spread, regime, direction FROM ({_EFFICIENT})", "hb"))
def window_records(spark, sf):
    return out(_efficient(spark, sf), "instrument", "idx", "net", "spread", "regime", "direction")


@query("u1_hooked_runs", sql(f"""SELECT instrument, min(idx) AS start_idx, max(idx) AS end_idx, arg_min(regime, pos) AS regime, min(direction) AS direction, count(*) AS bar_count
    FROM (SELECT *, sum(starts) OVER (PARTITION BY instrument ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN pos = 0 OR regime IS DISTINCT FROM lag(regime) OVER k OR direction IS DISTINCT FROM lag(direction) OVER k THEN 1 ELSE 0 END AS starts
        FROM ({_EFFICIENT}) WINDOW k AS (PARTITION BY instrument ORDER BY pos))) GROUP BY instrument, run""", "hb"))
def hooked_runs(spark, sf):
    """The walk with a classifier of the caller's own, merged into runs."""
    told = {"pos": F.col("idx") - (LOOKBACK - 1), "trend_waning": F.lit(False)}
    return out(walk.collapse_runs(_efficient(spark, sf).withColumns(told), KEYS), "instrument", "start_idx", "end_idx", "regime", "direction", "bar_count")


@query("w10_walk_forward_dirty", sql("""
    SELECT 'step' AS part, instrument, epoch(ts)::BIGINT AS ts, regime, direction, NULL::VARCHAR AS reason FROM hlab WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'
    UNION ALL SELECT 'reject', instrument, NULL, NULL, NULL, 'missing time' FROM hb WHERE idx = 0
    UNION ALL SELECT 'reject', 'short', NULL, NULL, NULL, 'too few warm-up bars'
    UNION ALL SELECT 'reject', 'ended', NULL, NULL, NULL, 'no complete bar on or after the start'""", "hlab"))
def walk_forward_dirty(spark, sf):
    """A walk over bars with incomplete, repeated, untimed and unusable ones, a short series and one that ended."""
    clean = hourly_ticks(spark, sf).persist()
    frm, to = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in (20, 28))
    arrived = clean.withColumn("arrival", F.lit(0))
    first = F.row_number().over(Window.partitionBy("instrument").orderBy("ts"))
    dirty = (
        arrived.unionByName(arrived.withColumns({"arrival": F.lit(1), "close": F.col("close") + 1}))
        .unionByName(arrived.withColumns({"arrival": F.lit(-1), "complete": F.lit(False), "close": F.lit(0.0)}))
        .unionByName(arrived.withColumn("_r", first).filter("_r = 1").drop("_r").withColumn("ts", F.lit(None).cast("timestamp")))
        .unionByName(arrived.filter((F.col("instrument") == "click") & (F.col("ts") >= frm)).withColumn("instrument", F.lit("short")))
        .unionByName(arrived.filter((F.col("instrument") == "click") & (F.col("ts") < frm)).withColumn("instrument", F.lit("ended")))
    )
    walked = walk_forward(dirty, KEYS, frm, to, LOOKBACK, arrival=["arrival"])
    steps = walked.steps.select(F.lit("step").alias("part"), "instrument", "ts", "regime", "direction", F.lit(None).cast("string").alias("reason"))
    rejects = walked.rejects.select(F.lit("reject").alias("part"), "instrument", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("regime"), F.lit(None).cast("string").alias("direction"), "reason")
    return out(steps.unionByName(rejects))


@query("w2_runs", outer("runs", """instrument, run::BIGINT AS run, regime, direction, trend_waning, start_idx, end_idx, epoch(start_ts)::BIGINT AS start_ts,
    epoch(end_ts)::BIGINT AS end_ts, high, low, bar_count"""))
def runs(spark, sf):
    found = walk.collapse_runs(hourly_labels(spark, sf), KEYS)
    return out(found, "instrument", "run", "regime", "direction", "trend_waning", "start_idx", "end_idx", "start_ts", "end_ts", "high", "low", "bar_count")


@query("w3_w4_state_buckets", sql("SELECT regime, trend_waning, band AS adx_band, count(*) AS n FROM scored0 GROUP BY 1, 2, 3", "scored0"))
def state_buckets(spark, sf):
    bucket = hourly_labels(spark, sf).select(walk.state_bucket().alias("b")).select("b.*")
    return out(bucket.groupBy("regime", "trend_waning", "adx_band").agg(F.count("*").alias("n")))


@query("w5_w6_w7_w8_change_probability", outer("scored", """instrument, idx, pos, instability::DOUBLE AS instability, n_hist, p_hat, eval_changed,
    eval_p_hat, eval_brier, CASE WHEN p_hat IS NULL THEN 'insufficient_history' END AS p_hat_note"""))
def change_probability(spark, sf):
    scored = walk.attach_change_prob(hourly_labels(spark, sf), KEYS)
    return out(scored, "instrument", "idx", "pos", "instability", "n_hist", "p_hat", "eval_changed", "eval_p_hat", "eval_brier", "p_hat_note")


@query("w9_w10_walk_summary", sql("""
    SELECT s.*, run_count FROM (
        SELECT instrument, count(*) AS step_count, count(*) FILTER (WHERE regime = 'trend') AS trend_steps,
            count(*) FILTER (WHERE regime = 'range') AS range_steps, count(*) FILTER (WHERE regime = 'mixed') AS mixed_steps,
            round_even(avg(p_hat), 4) AS mean_p_hat, count(p_hat) AS p_hat_defined, count(eval_p_hat) AS completed_forecasts,
            round_even(avg(eval_brier), 4) AS brier,
            round_even(count(*) FILTER (WHERE eval_p_hat IS NOT NULL AND eval_changed) / nullif(count(eval_p_hat), 0), 4) AS hit_rate,
            arg_max(p_hat, CASE WHEN p_hat IS NOT NULL OR true THEN pos END) FILTER (WHERE pos = mp) AS last_p_hat,
            arg_max(instability::DOUBLE, pos) AS last_instability
        FROM (SELECT *, max(pos) OVER (PARTITION BY instrument) AS mp FROM scored) GROUP BY 1) s
    JOIN (SELECT instrument, count(*) AS run_count FROM runs GROUP BY 1) USING (instrument)""", "scored", "runs"))
def walk_summary(spark, sf):
    result = walk.walk_and_collapse(hourly(spark, sf), KEYS, LOOKBACK)
    return out(
        result.summary, "instrument", "step_count", "trend_steps", "range_steps", "mixed_steps", "mean_p_hat", "p_hat_defined",
        "completed_forecasts", "brier", "hit_rate", "last_p_hat", "last_instability", "run_count",
    )


@query("f11_change_watch", sql("""SELECT instrument, idx, p_hat, instability::DOUBLE AS instability FROM scored
    WHERE p_hat >= 0.5 OR instability >= 0.6""", "scored"))
def change_watch(spark, sf):
    scored = walk.attach_change_prob(hourly_labels(spark, sf), KEYS)
    return out(walk.change_watch(scored), "instrument", "idx", "p_hat", "instability")


# Patterns -----------------------------------------------------------------------

_TILED = f"""
    pv AS MATERIALIZED (SELECT * FROM (
        SELECT instrument, tile, i AS idx, 'high' AS kind, high AS price FROM sw WHERE is_high
        UNION ALL SELECT instrument, tile, i, 'low', low FROM sw WHERE is_low)),
    win AS MATERIALIZED (SELECT instrument, tile, max(i) AS last_idx, count(*) AS bar_count, arg_max(close, i) AS last_close,
        arg_max(coalesce(atr, high - low), i) AS atr,
        CASE WHEN 0.15 * arg_max(coalesce(atr, high - low), i) > 0 THEN arg_max(coalesce(atr, high - low), i) * 0.15
            ELSE abs(arg_max(close, i)) * 1e-4 END AS tolerance FROM sw GROUP BY 1, 2)"""
_SW = f"""
    WITH tl AS (SELECT *, idx - tile * {STRIDE} AS i FROM (SELECT *, unnest(range(CASE WHEN idx < {TILE} THEN 0 ELSE (idx - {TILE}) // {STRIDE} + 1 END, idx // {STRIDE} + 1)) AS tile FROM {{source}})),
    sw AS MATERIALIZED (SELECT *, c7 = 7 AND high >= h7 AS is_high, c7 = 7 AND low <= l7 AS is_low,
        avg(tr1) OVER (PARTITION BY instrument, tile ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr
    FROM (SELECT *, count(*) OVER f AS c7, max(high) OVER f AS h7, min(low) OVER f AS l7,
            CASE WHEN i > 0 THEN greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) END AS tr1
        FROM tl WINDOW f AS (PARTITION BY instrument, tile ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
            o AS (PARTITION BY instrument, tile ORDER BY i))),
    {_TILED}"""
TILES = [*KEYS, "tile"]


def _tiled_sql(select: str, source: str = "hb") -> str:
    head = sql("@@", source)
    return head.replace("@@", _SW.format(source=source).lstrip().replace("WITH tl", ", tl", 1) + select)


def _tiled(spark, sf):
    """The whole table as overlapping analysis windows."""
    return tiles(hourly(spark, sf), TILE, stride=STRIDE)


@query("p1_swings", sql("""SELECT instrument, idx, kind, price FROM (
    SELECT instrument, idx, 'high' AS kind, high AS price, high >= h7 AND c7 = 7 AS hit FROM s UNION ALL
    SELECT instrument, idx, 'low', low, low <= l7 AND c7 = 7 FROM s) WHERE hit""", "hb").replace("\nSELECT instrument, idx, kind", """,
    s AS (SELECT *, count(*) OVER f AS c7, max(high) OVER f AS h7, min(low) OVER f AS l7 FROM hb
        WINDOW f AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT instrument, idx, kind""", 1))
def swings(spark, sf):
    return out(patterns.detect_swings(hourly(spark, sf), KEYS), "instrument", "idx", "kind", "price")


@query("p2_p3_trendlines", _tiled_sql("""
    , seg AS (SELECT *, lead(idx) OVER k AS i1, lead(price) OVER k AS p1 FROM pv WINDOW k AS (PARTITION BY instrument, tile, kind ORDER BY idx))
    SELECT instrument, tile, line_no - 1 AS line_no, CASE kind WHEN 'high' THEN 'resistance' ELSE 'support' END AS kind, i0, i1,
        price0, price1, round(slope, 6) AS slope, round(price0 + slope * (last_idx - i0), 6) AS price_at_last, touches, round(tolerance, 6) AS tolerance
    FROM (SELECT *, row_number() OVER (PARTITION BY instrument, tile ORDER BY touches DESC, i1 DESC, kind, i0) AS line_no FROM (
        SELECT s.instrument, s.tile, s.kind, s.idx AS i0, s.i1, s.price AS price0, s.p1 AS price1, (s.p1 - s.price) / (s.i1 - s.idx) AS slope,
            w.last_idx, w.tolerance,
            count(*) FILTER (WHERE abs(p.price - (s.price + (s.p1 - s.price) / (s.i1 - s.idx) * (p.idx - s.idx))) <= w.tolerance) AS touches
        FROM seg s JOIN win w USING (instrument, tile) JOIN pv p ON p.instrument = s.instrument AND p.tile = s.tile AND p.kind = s.kind
        WHERE s.i1 IS NOT NULL GROUP BY ALL)) WHERE line_no <= 5"""))
def trendlines(spark, sf):
    lines = patterns.propose_trendlines(patterns.analysis_windows(_tiled(spark, sf), TILES), TILES)
    return out(lines, "instrument", "tile", "line_no", "kind", "i0", "i1", "price0", "price1", "slope", "price_at_last", "touches", "tolerance")


_FORMATIONS = """
    , hi7 AS (SELECT *, row_number() OVER k AS n, count(*) OVER (PARTITION BY instrument, tile) AS total, lead(idx) OVER k AS hx, lead(price) OVER k AS hp,
            lead(idx, 2) OVER k AS rx, lead(price, 2) OVER k AS rp, lag(idx) OVER k AS qx, lag(price) OVER k AS qp
        FROM pv WHERE kind = 'high' WINDOW k AS (PARTITION BY instrument, tile ORDER BY idx)),
    tri AS (SELECT * FROM hi7 WHERE hp > price AND hp > rp QUALIFY row_number() OVER (PARTITION BY instrument, tile ORDER BY idx DESC) = 1),
    fin AS (SELECT * FROM hi7 WHERE n = total),
    nk AS (SELECT t.*, (SELECT max(p.idx) FROM pv p WHERE p.instrument = t.instrument AND p.tile = t.tile AND p.kind = 'low' AND p.idx > t.idx AND p.idx < t.hx) AS ax,
            (SELECT max(p.idx) FROM pv p WHERE p.instrument = t.instrument AND p.tile = t.tile AND p.kind = 'low' AND p.idx > t.hx AND p.idx < t.rx) AS bx,
            EXISTS (SELECT 1 FROM pv p WHERE p.instrument = t.instrument AND p.tile = t.tile AND p.kind = 'high' AND p.idx > t.rx AND p.price > t.hp) AS over_head
        FROM tri t),
    nl AS (SELECT nk.*, a.price AS ap, b.price AS bp FROM nk
        LEFT JOIN pv a ON a.instrument = nk.instrument AND a.tile = nk.tile AND a.kind = 'low' AND a.idx = ax
        LEFT JOIN pv b ON b.instrument = nk.instrument AND b.tile = nk.tile AND b.kind = 'low' AND b.idx = bx),
    al AS (SELECT w.instrument, w.tile, w.last_close, w.last_idx, n.idx AS lx, n.hx AS hx, n.rx AS rx, n.hp AS hp, n.over_head, f.total, f.idx AS fx, f.price AS fp, f.qx, f.qp,
            CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ap + (bp - ap) / (bx - ax) * (w.last_idx - ax) END AS neck,
            CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN n.hp - (ap + (bp - ap) / (bx - ax) * (n.hx - ax)) END AS h, ax, bx
        FROM win w LEFT JOIN nl n USING (instrument, tile) LEFT JOIN fin f USING (instrument, tile)),
    st AS (SELECT *, CASE WHEN total IS NULL THEN 'none' WHEN lx IS NULL AND coalesce(fp > qp, false) THEN 'head' WHEN lx IS NULL THEN 'left_shoulder'
            WHEN neck IS NULL THEN 'right_shoulder_forming' WHEN over_head THEN 'invalidated' WHEN last_close < neck * (1.0 - 0.001) THEN 'confirmed_break'
            ELSE 'neckline_tentative' END AS stage FROM al)"""


@query("p4_p5_formations", _tiled_sql(_FORMATIONS + """
    SELECT instrument, tile, stage, last_close, coalesce(lx, CASE WHEN fp > qp THEN qx ELSE fx END) AS left_idx,
        coalesce(hx, CASE WHEN lx IS NULL AND fp > qp THEN fx END) AS head_idx, rx AS right_idx, CASE WHEN neck IS NOT NULL THEN ax END AS neck_i0, CASE WHEN neck IS NOT NULL THEN bx END AS neck_i1,
        round(neck, 6) AS neck_at_last, round(CASE WHEN h > 0 THEN h END, 6) AS height,
        round(CASE WHEN stage = 'confirmed_break' AND h > 0 THEN neck - h END, 6) AS min_target FROM st"""))
def formations(spark, sf):
    found = patterns.formation(patterns.analysis_windows(_tiled(spark, sf), TILES), TILES)
    return out(
        found.select(
            "instrument", "tile", "stage", "last_close", F.col("left_shoulder.idx").alias("left_idx"), F.col("head.idx").alias("head_idx"),
            F.col("right_shoulder.idx").alias("right_idx"), F.col("neckline.i0").alias("neck_i0"), F.col("neckline.i1").alias("neck_i1"),
            F.col("neckline.price_at_last").alias("neck_at_last"), "height", "min_target",
        )
    )


@query("p6_window_analyses", _tiled_sql("""
    SELECT w.instrument, w.tile, w.bar_count, w.last_close, coalesce(n, 0) AS swing_count, coalesce(n, 0) AS kept,
        coalesce(first_kept, -1) AS first_kept
    FROM win w LEFT JOIN (SELECT instrument, tile, count(*) AS n, min(idx) AS first_kept FROM pv GROUP BY 1, 2) USING (instrument, tile)"""))
def window_analyses(spark, sf):
    found = patterns.analyze_windows(_tiled(spark, sf), TILES)
    return out(
        found.select(
            "instrument", "tile", "bar_count", "last_close", "swing_count", F.size("swings").alias("kept"),
            F.coalesce(F.try_element_at("swings", F.lit(1))["idx"], F.lit(-1)).alias("first_kept"),
        )
    )
