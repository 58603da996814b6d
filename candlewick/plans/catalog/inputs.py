"""Tables and derived inputs shared by the registered queries, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.functions.times import bar_start
from candlewick.operators.series import index_rows
from candlewick.operators.walk import label_steps
from candlewick.sources.candles import bars_from_ticks

KEYS = ["instrument", "granularity"]
LOOKBACK = 250
DAY = 86_400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw hourly bars of ``events``, one series per event type."""
    events = table(spark, sf, "events")
    return bars_from_ticks(
        events, F.col("event_type"), "H1", F.col("ts").cast("timestamp"), F.col("value"), F.col("event_id")
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered hourly bars; persisted because numbering reads them twice."""
    return index_rows(hourly_ticks(spark, sf).persist(), KEYS, bucket_seconds=40 * DAY).persist()


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered daily unit-price bars of ``lineitem``, one series per supplier; store them where they are read again.

    Most bars are one line: lines are dealt once, and the days of each supplier are counted from narrow rows.
    """
    lines = table(spark, sf, "lineitem")
    supplier, shipped = F.concat(F.lit("SUP_"), F.col("l_suppkey").cast("string")), F.col("l_shipdate").cast("timestamp")
    bars = bars_from_ticks(
        lines, supplier, "D", shipped, F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), 1000 * DAY
    )
    days = lines.select(supplier.alias("instrument"), F.lit("D").alias("granularity"), bar_start(shipped, "D").alias("ts")).distinct()
    return index_rows(bars, KEYS, bucket_seconds=1000 * DAY, times=days)


def hourly_labels(spark: SparkSession, sf: str) -> DataFrame:
    return label_steps(hourly(spark, sf), KEYS, LOOKBACK).persist()


def out(df: DataFrame, *columns, digits: int = 6, times: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Result columns: times as epoch seconds, integers as bigint, doubles rounded."""
    chosen = df.select(*columns) if columns else df
    result = []
    for name, kind in chosen.dtypes:
        c = F.col(name)
        if name in times or kind == "timestamp":
            c = F.unix_seconds(c)
        elif kind == "double":
            c = F.round(c, digits)
        elif kind in ("int", "bigint", "tinyint", "smallint"):
            c = c.cast("bigint")
        result.append(c.alias(name))
    return chosen.select(*result)


# SQL counterparts ---------------------------------------------------------------

SMA = (10, 20, 50, 100, 200)


def _frame(column: str, period: int, how: str) -> str:
    over = f"OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) {over} = {period} THEN {how}({column}) {over} END"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "hb": ((), """
        SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS idx FROM (
            SELECT event_type AS instrument, date_trunc('hour', ts) AS ts,
                first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
                last(value ORDER BY events.ts, event_id) AS close, count(*) AS volume
            FROM events GROUP BY 1, 2)"""),
    "db": ((), """
        SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS idx FROM (
            SELECT 'SUP_' || l_suppkey AS instrument, date_trunc('day', l_shipdate) AS ts,
                first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS open,
                max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
                last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber) AS close, count(*) AS volume
            FROM lineitem GROUP BY 1, 2)"""),
}


def _indicator_sql(source: str) -> str:
    smas = ", ".join(f"{_frame('close', p, 'avg')} AS sma_{p}" for p in SMA)
    w = "OVER (PARTITION BY instrument ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    w14, w10, w3 = w.format(13), w.format(9), w.format(2)
    lag = "OVER (PARTITION BY instrument ORDER BY idx)"
    return f"""
        SELECT *, CASE WHEN count(stoch_k) {w3} = 3 THEN avg(stoch_k) {w3} END AS stoch_d FROM (
        SELECT *, CASE WHEN count(raw_k) {w3} = 3 THEN avg(raw_k) {w3} END AS stoch_k FROM (
        SELECT *, sma_20 AS bb_mid, sma_20 + 2.0 * sd AS bb_upper_2, sma_20 + sd AS bb_upper_1,
            sma_20 - sd AS bb_lower_1, sma_20 - 2.0 * sd AS bb_lower_2,
            CASE WHEN n14 = 14 THEN CASE WHEN h14 = l14 THEN 50.0 ELSE 100.0 * (close - l14) / (h14 - l14) END END AS raw_k,
            CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
            CASE WHEN pc IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS plus_dm,
            CASE WHEN pc IS NULL THEN NULL WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS minus_dm
        FROM (SELECT *, {smas}, {_frame('close', 20, 'stddev_pop')} AS sd,
            count(close) {w14} AS n14, max(high) {w14} AS h14, min(low) {w14} AS l14,
            max(high) {w10} AS high_n, min(low) {w10} AS low_n,
            lag(close) {lag} AS pc, lag(high) {lag} AS ph, lag(low) {lag} AS pl
        FROM {source})))"""


def _recursion_sql(source: str, lookback: int | None) -> str:
    """All windows stepped together, one position per iteration; without a look-back, whole series."""
    last = lookback - 1 if lookback else 0
    windows = f"SELECT instrument, idx AS e FROM {source} WHERE idx >= {last}" if lookback else f"SELECT DISTINCT instrument, 0 AS e FROM {source}"
    return f"""
        SELECT r.instrument, r.e, 0 AS m, b.close AS c, b.close AS f12, b.close AS f26, 0::DOUBLE AS sig, 0::DOUBLE AS g, 0::DOUBLE AS l,
            0::DOUBLE AS str, 0::DOUBLE AS sp, 0::DOUBLE AS sm, 0::DOUBLE AS pdi, 0::DOUBLE AS mdi, 0::DOUBLE AS adx, NULL::DOUBLE AS then_adx
        FROM ({windows}) r
        JOIN {source} b ON b.instrument = r.instrument AND b.idx = r.e - {last}
        UNION ALL
        SELECT instrument, e, m, c, f12, f26,
            CASE WHEN m < 25 THEN 0.0 WHEN m = 25 THEN f12 - f26 WHEN m < 33 THEN sig + (f12 - f26)
                WHEN m = 33 THEN (sig + (f12 - f26)) / 9 ELSE (f12 - f26) * 0.2 + sig * 0.8 END,
            g, l, str, sp, sm, pdi, mdi, nadx, CASE WHEN m = {last - 5} AND m >= 27 THEN nadx ELSE then_adx END
        FROM (SELECT *, CASE WHEN m < 14 THEN 0.0 WHEN m = 14 THEN dx WHEN m < 27 THEN adx + dx
                WHEN m = 27 THEN (adx + dx) / 14 ELSE (adx * 13 + dx) / 14 END AS nadx
        FROM (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0.0 ELSE 100.0 * abs(pdi - mdi) / (pdi + mdi) END AS dx
        FROM (SELECT *, CASE WHEN str = 0 THEN 0.0 ELSE 100.0 * sp / str END AS pdi,
                CASE WHEN str = 0 THEN 0.0 ELSE 100.0 * sm / str END AS mdi
        FROM (SELECT r.instrument, r.e, r.m + 1 AS m, b.close AS c, r.sig, r.adx, r.then_adx,
                CASE WHEN r.m + 1 < 11 THEN r.f12 + b.close WHEN r.m + 1 = 11 THEN (r.f12 + b.close) / 12
                    ELSE b.close * (2.0 / 13) + r.f12 * (1 - 2.0 / 13) END AS f12,
                CASE WHEN r.m + 1 < 25 THEN r.f26 + b.close WHEN r.m + 1 = 25 THEN (r.f26 + b.close) / 26
                    ELSE b.close * (2.0 / 27) + r.f26 * (1 - 2.0 / 27) END AS f26,
                {_wilder('g', 'greatest(b.close - r.c, 0.0)')} AS g, {_wilder('l', 'greatest(r.c - b.close, 0.0)')} AS l,
                {_wilder('str', 'b.tr')} AS str, {_wilder('sp', 'b.plus_dm')} AS sp, {_wilder('sm', 'b.minus_dm')} AS sm
            FROM {{name}} r JOIN {source} b ON b.instrument = r.instrument AND b.idx = r.e - {last} + r.m + 1
            {f"WHERE r.m < {last}" if lookback else ""}))))"""


def _wilder(state: str, x: str) -> str:
    return (
        f"CASE WHEN r.m + 1 < 14 THEN r.{state} + {x} WHEN r.m + 1 = 14 THEN (r.{state} + {x}) / 14 "
        f"ELSE (r.{state} * 13 + {x}) / 14 END"
    )


_SIX = [f"sma_{p}" for p in SMA] + ["bb_mid", "bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2", "high_n", "low_n"]


def _snapshot_sql(indicators: str, recursion: str, lookback: int) -> str:
    six = ", ".join(
        f"round_even(i.{c}, 6) AS {c}" if not c.startswith("sma_") or int(c[4:]) <= lookback else f"NULL::DOUBLE AS {c}"
        for c in _SIX
    )
    vs = ", ".join(
        f"CASE WHEN close > sma_{p} THEN 'above' WHEN close < sma_{p} THEN 'below' WHEN close = sma_{p} THEN 'at' END AS vs_sma_{p}"
        for p in SMA
    )
    up = " AND ".join(f"sma_{a} > sma_{b}" for a, b in zip(SMA, SMA[1:]))
    down = " AND ".join(f"sma_{a} < sma_{b}" for a, b in zip(SMA, SMA[1:]))
    return f"""
        SELECT *, {vs}, CASE WHEN {up} THEN 'up' WHEN {down} THEN 'down' END AS ma_perfect_order,
            CASE WHEN bb_mid <> 0 THEN round_even((bb_upper_2 - bb_lower_2) / bb_mid, 6) END AS bb_width,
            CASE WHEN bb_upper_1 IS NULL THEN 'unknown' WHEN bb_upper_1 - bb_lower_1 <= 1e-12 THEN 'range'
                WHEN close > bb_upper_1 THEN 'trend_up' WHEN close < bb_lower_1 THEN 'trend_down' ELSE 'range' END AS bb_zone
        FROM (SELECT i.instrument, i.idx, i.ts, i.open, i.high, i.low, i.close, round_even(i.close, 6) AS last_close, {six},
            round_even(i.stoch_k, 4) AS stoch_k, round_even(i.stoch_d, 4) AS stoch_d,
            round_even(r.f12 - r.f26, 6) AS macd, round_even(r.sig, 6) AS macd_signal,
            round_even(r.f12 - r.f26 - r.sig, 6) AS macd_hist,
            round_even(CASE WHEN r.l = 0 THEN CASE WHEN r.g > 0 THEN 100.0 ELSE 50.0 END WHEN r.g = 0 THEN 0.0
                ELSE 100.0 - 100.0 / (1.0 + r.g / r.l) END, 4) AS rsi,
            round_even(r.adx, 4) AS adx, round_even(r.pdi, 4) AS plus_di, round_even(r.mdi, 4) AS minus_di,
            round_even(r.adx - r.then_adx, 4) AS adx_slope, coalesce(r.adx - r.then_adx > 0, false) AS adx_rising
        FROM {indicators} i JOIN {recursion} r ON r.instrument = i.instrument AND r.e = i.idx AND r.m = {lookback - 1})"""


def _label_sql(snapshots: str) -> str:
    order = "ma_perfect_order"
    return f"""
        SELECT *, CASE WHEN trend_waning THEN 'breakout_watch' WHEN regime = 'trend' THEN 'join_trend'
                WHEN regime = 'range' THEN 'fade_range' ELSE 'breakout_watch' END AS play_class,
            round_even(CASE regime WHEN 'trend' THEN trend_n / 6.0 WHEN 'range' THEN range_n / 6.0
                ELSE least(trend_n, range_n) / greatest(trend_n + range_n, 1)::DOUBLE END, 3) AS confidence
        FROM (SELECT *, CASE WHEN trend_waning THEN 'mixed'
                WHEN trend_n >= 3 AND adx > 25 THEN 'trend' WHEN range_n >= 3 AND adx < 25 THEN 'range'
                WHEN bb_zone = 'range' AND adx < 25 THEN 'range' WHEN bb_zone LIKE 'trend%' AND adx > 25 THEN 'trend'
                ELSE 'mixed' END AS regime
        FROM (SELECT *, c_adx_above::INT + adx_rising::INT + c_outer::INT + c_break::INT + c_order::INT + c_osc::INT AS trend_n,
                r_below_25::INT + r_below_20::INT + r_falling::INT + r_inside::INT + r_rsi::INT + r_stoch::INT AS range_n
        FROM (SELECT *, coalesce(adx > 25, false) AS c_adx_above, bb_zone LIKE 'trend%' AS c_outer,
                coalesce(CASE direction WHEN 'up' THEN vs_sma_50 = 'above' WHEN 'down' THEN vs_sma_50 = 'below' END, false)
                    OR coalesce(CASE direction WHEN 'up' THEN vs_sma_100 = 'above' WHEN 'down' THEN vs_sma_100 = 'below' END, false) AS c_break,
                {order} IS NOT NULL AS c_order,
                CASE direction
                    WHEN 'up' THEN coalesce(rsi > 50, false)::INT + coalesce(stoch_k > 50 OR stoch_k >= stoch_d, false)::INT
                        + coalesce(macd_hist > 0, false)::INT >= 2
                    WHEN 'down' THEN coalesce(rsi < 50, false)::INT + coalesce(stoch_k < 50 OR stoch_k <= stoch_d, false)::INT
                        + coalesce(macd_hist < 0, false)::INT >= 2
                    ELSE false END AS c_osc,
                coalesce(adx < 25, false) AS r_below_25, coalesce(adx < 20, false) AS r_below_20,
                coalesce(adx_slope < 0, false) AS r_falling, bb_zone = 'range' AS r_inside,
                coalesce(rsi >= 70 OR rsi <= 30, false) AS r_rsi, coalesce(stoch_k >= 80 OR stoch_k <= 20, false) AS r_stoch,
                coalesce(adx > 25 AND adx_slope < 0 AND (adx >= 35 OR adx >= 40 OR adx - adx_slope >= 40), false) AS trend_waning
        FROM (SELECT *, CASE WHEN {order} IS NOT NULL THEN {order}
                WHEN plus_di > minus_di THEN 'up' WHEN plus_di < minus_di THEN 'down'
                WHEN vs_sma_20 = 'above' THEN 'up' WHEN vs_sma_20 = 'below' THEN 'down'
                WHEN bb_zone = 'trend_up' THEN 'up' WHEN bb_zone = 'trend_down' THEN 'down' END AS direction
        FROM {snapshots}))))"""


_PROB = """
    SELECT *, CASE WHEN n_hist >= 10 THEN round_even(hits / n_hist, 4) END AS p_hat FROM (
    SELECT s.*, (SELECT count(*) FROM scored0 j WHERE j.instrument = s.instrument AND j.pos <= s.pos - 5
                AND j.regime = s.regime AND j.trend_waning = s.trend_waning AND j.band = s.band) AS n_hist,
        (SELECT count(*) FROM scored0 j WHERE j.instrument = s.instrument AND j.pos <= s.pos - 5
                AND j.regime = s.regime AND j.trend_waning = s.trend_waning AND j.band = s.band AND j.flips) AS hits
    FROM scored0 s)"""

_TOUCH = """(c.side = 'long' AND (b.low <= c.stop OR b.high >= c.target)
            OR c.side = 'short' AND (b.high >= c.stop OR b.low <= c.target))"""

CTES |= {
    "hi": (("hb",), _indicator_sql("hb")),
    "di": (("db",), _indicator_sql("db")),
    "hrec": (("hi",), _recursion_sql("hi", LOOKBACK)),
    "hsnap": (("hi", "hrec"), _snapshot_sql("hi", "hrec", LOOKBACK)),
    "hlab": (("hsnap",), _label_sql("hsnap")),
    "steps": (("hlab",), f"SELECT *, idx - {LOOKBACK - 1} AS pos FROM hlab"),
    "scored0": (("steps",), """
        SELECT s.*, CASE WHEN adx < 20 THEN 'lt20' WHEN adx <= 30 THEN '20_30' WHEN adx > 30 THEN 'gt30' ELSE 'unknown' END AS band,
            round_even(least(1.0,
                CASE WHEN regime = 'mixed' OR trend_waning THEN 0.25 ELSE 0.0 END
                + CASE WHEN coalesce(adx BETWEEN 20 AND 30, false) OR coalesce(regime = 'trend' AND adx_slope < 0, false)
                    OR (regime = 'range' AND adx_rising) THEN 0.25 ELSE 0.0 END
                + CASE WHEN abs(trend_n - range_n) <= 1 THEN 0.20 ELSE 0.0 END
                + CASE WHEN prev_order IS NOT NULL AND prev_order IS DISTINCT FROM ma_perfect_order THEN 0.15 ELSE 0.0 END
                + CASE WHEN confidence < 0.5 THEN 0.15 ELSE 0.0 END), 3) AS instability,
            CASE WHEN next_regime IS NOT NULL THEN regime <> next_regime
                OR (regime = 'trend' AND direction IS DISTINCT FROM next_direction) END AS flips
        FROM (SELECT *, lag(ma_perfect_order) OVER k AS prev_order, lead(regime, 5) OVER k AS next_regime,
                lead(direction, 5) OVER k AS next_direction
            FROM steps WINDOW k AS (PARTITION BY instrument ORDER BY pos)) s"""),
    "probs": (("scored0",), _PROB),
    "scored": (("probs",), """
        SELECT *, CASE WHEN eval_p_hat IS NOT NULL THEN round_even((eval_p_hat - eval_changed::INT) ** 2, 4) END AS eval_brier
        FROM (SELECT *, lag(p_hat, 5) OVER k AS eval_p_hat, lag(flips, 5) OVER k AS eval_changed FROM probs
            WINDOW k AS (PARTITION BY instrument ORDER BY pos))"""),
    "runs": (("steps",), """
        SELECT instrument, run, arg_min(regime, pos) AS regime, min(direction) AS direction, bool_or(trend_waning) AS trend_waning,
            min(idx) AS start_idx, max(idx) AS end_idx, min(ts) AS start_ts, max(ts) AS end_ts,
            max(high) AS high, min(low) AS low, count(*) AS bar_count
        FROM (SELECT *, sum(starts) OVER (PARTITION BY instrument ORDER BY pos) - 1 AS run FROM (
            SELECT *, CASE WHEN pos = 0 OR regime IS DISTINCT FROM lag(regime) OVER k OR direction IS DISTINCT FROM lag(direction) OVER k
                THEN 1 ELSE 0 END AS starts FROM steps WINDOW k AS (PARTITION BY instrument ORDER BY pos)))
        GROUP BY instrument, run"""),
    "tickets": (("steps",), """
        SELECT *, CASE WHEN ok THEN CASE WHEN (t0 - e) / (e - s) >= 2.0 THEN t0 WHEN (t1 - e) / (e - s) >= 2.0 THEN t1 END END AS target,
            CASE WHEN ok AND ((t0 - e) / (e - s) >= 2.0 OR (t1 - e) / (e - s) >= 2.0) THEN side0 ELSE 'none' END AS side
        FROM (SELECT *, round_even((t0 + sgn * 0.0001) / 0.0001, 0) * 0.0001 AS t1 FROM (
        SELECT *, round_even((e + sgn * 2.0 * abs(e - s)) / 0.0001, 0) * 0.0001 AS t0,
            side0 IS NOT NULL AND abs(e - s) >= 0.0001 AND CASE side0 WHEN 'long' THEN s < e ELSE s > e END AS ok FROM (
        SELECT *, round_even(last_close / 0.0001, 0) * 0.0001 AS e, CASE side0 WHEN 'long' THEN 1.0 ELSE -1.0 END AS sgn,
            round_even(CASE side0 WHEN 'long' THEN low_n - 10 * 0.0001 ELSE high_n + 10 * 0.0001 END / 0.0001, 0) * 0.0001 AS s FROM (
        SELECT *, CASE WHEN trend_waning THEN NULL
            WHEN play_class = 'join_trend' THEN CASE direction WHEN 'up' THEN 'long' WHEN 'down' THEN 'short' END
            WHEN play_class = 'fade_range' THEN CASE WHEN last_close >= bb_mid THEN 'short' ELSE 'long' END END AS side0
        FROM steps))))"""),
    "cands": (("tickets",), """
        SELECT instrument, idx AS entry_idx, ts AS entry_ts, side, play_class, e AS entry, s AS stop, target FROM tickets
        WHERE side <> 'none'"""),
    "ends": (("hb",), "SELECT instrument, max(idx) AS last_idx, max(ts) AS last_ts, arg_max(close, idx) AS last_close FROM hb GROUP BY 1"),
    "exits": (("cands", "ends"), f"""
        SELECT *, round_even((exit_price - entry) / (entry - stop), 4) AS r_realized FROM (
        SELECT x.* EXCLUDE (xidx), coalesce(xidx, n.last_idx) AS exit_idx, coalesce(b.ts, n.last_ts) AS exit_ts,
            CASE WHEN xidx IS NULL THEN 'window_end'
                WHEN (side = 'long' AND b.low <= stop) OR (side = 'short' AND b.high >= stop) THEN 'stop' ELSE 'target' END AS exit_status,
            CASE WHEN xidx IS NULL THEN n.last_close
                WHEN (side = 'long' AND b.low <= stop) OR (side = 'short' AND b.high >= stop) THEN stop ELSE target END AS exit_price
        FROM (SELECT c.*, (SELECT min(b.idx) FROM hb b WHERE b.instrument = c.instrument AND b.idx > c.entry_idx AND {_TOUCH}) AS xidx
            FROM cands c) x
        LEFT JOIN hb b ON b.instrument = x.instrument AND b.idx = x.xidx
        JOIN ends n ON n.instrument = x.instrument)"""),
    "taken": (("exits",), """
        SELECT e.* FROM exits e JOIN (
            SELECT instrument, min(entry_idx) AS entry_idx FROM exits GROUP BY 1) f USING (instrument, entry_idx)
        UNION ALL
        SELECT e.* FROM (SELECT t.instrument, min(c.entry_idx) AS entry_idx FROM {name} t
            JOIN exits c ON c.instrument = t.instrument AND c.entry_idx > t.exit_idx GROUP BY 1) n
        JOIN exits e USING (instrument, entry_idx)"""),
}
#: The chain of CTEs from numbered bars to trades, repeated over other bars under names with a prefix.
_CHAIN = ("hb", "hi", "hrec", "hsnap", "hlab", "steps", "tickets", "cands", "ends", "exits", "taken")
_NAMED = re.compile(rf"(?<![.\w])({'|'.join(_CHAIN)})(?=\b(?! AS\b))")


def chained(prefix: str, bars: str) -> dict[str, tuple[tuple[str, ...], str]]:
    named = lambda n: bars if n == "hb" else prefix + n
    return {prefix + n: (tuple(map(named, CTES[n][0])), _NAMED.sub(lambda m: named(m[1]), CTES[n][1])) for n in _CHAIN[1:]}


# Hourly bars that arrive in five slices, every fortieth a slice too late; six hours later than the newest is late.
CTES |= {
    "arr": (("hb",), """SELECT *, floor((epoch(ts)::BIGINT - low) * 4 / (high_ts - low + 1))::BIGINT + (idx % 40 = 3)::INT AS slice
        FROM (SELECT *, (SELECT epoch(min(ts))::BIGINT FROM hb) AS low_ts, (SELECT epoch(max(ts))::BIGINT FROM hb) AS high_ts FROM hb)""".replace("- low", "- low_ts")),
    "late": (("arr",), """SELECT a.* FROM arr a JOIN (
        SELECT c.s, c.instrument, max(b.ts) AS last FROM (SELECT s, instrument, max(ts) AS newest FROM arr JOIN (SELECT unnest(range(0, 5)) AS s) ON slice <= s GROUP BY ALL) c
        JOIN arr b ON b.instrument = c.instrument AND b.slice <= c.s AND b.ts <= c.newest - INTERVAL 6 HOUR GROUP BY ALL) l
        ON l.instrument = a.instrument AND l.s = a.slice - 1 AND a.ts <= l.last"""),
    "xb": (("hb", "late"), """SELECT instrument, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS idx
        FROM hb WHERE (instrument, ts) NOT IN (SELECT (instrument, ts) FROM late)"""),
}
CTES |= chained("d_", "db") | chained("x_", "xb")
CTES["d_whole"] = (("d_hi",), _recursion_sql("d_hi", None))
RECURSIVE = ("hrec", "taken", "d_hrec", "d_taken", "d_whole", "x_hrec", "x_taken")


def sql(select: str, *needed: str) -> str:
    """``select`` over the named CTEs and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in order) else ""
    body = lambda n: CTES[n][1].replace("{name}", n)
    kind = lambda n: "" if n in RECURSIVE else "MATERIALIZED "
    return f"WITH {recursive}" + ",\n".join(f"{n} AS {kind(n)}({body(n)})" for n in order) + f"\n{select}"


def outer(source: str, columns: str, *needed: str) -> str:
    return sql(f"SELECT {columns} FROM {source}", *(needed or (source,)))
