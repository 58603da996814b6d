"""Tickets, gate, exits, journal tables and annotations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from candlewick.functions import tickets as tk
from candlewick.functions.times import ticket_stamp_seconds
from candlewick.operators import annotations as ann, journal, outcomes, patterns, walk
from candlewick.operators.indicators import indicator_blocks, last_snapshots, plot_series
from candlewick.operators.regime import classify
from candlewick.operators.series import tiles
from candlewick.plans.catalog.analytics import STRIDE, TILE, TILES
from candlewick.plans.catalog.inputs import KEYS, LOOKBACK, SMA, daily, hourly, hourly_labels, out, outer, sql, table
from candlewick.plans.registry import query
from candlewick.session import stored_once

PAPER = tk.Goal(mode="paper")
_ID = "md5(instrument || '|H1|' || entry_idx)"


@query("l1_l2_pips", """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
        CASE WHEN l_suppkey % 3 = 0 THEN 0.01 ELSE 0.0001 END::DOUBLE AS pip,
        round(round_even(l_extendedprice / l_quantity / CASE WHEN l_suppkey % 3 = 0 THEN 0.01 ELSE 0.0001 END, 0)
            * CASE WHEN l_suppkey % 3 = 0 THEN 0.01 ELSE 0.0001 END, 6) AS price FROM lineitem""")
def pips(spark, sf):
    kind = F.col("l_suppkey") % 3
    instrument = F.when(kind == 0, "usd/jpy").when(kind == 1, "EUR_USD").otherwise("AUDNZD")
    pip = tk.pip_size(instrument)
    lines = table(spark, sf, "lineitem")
    return out(lines.select("l_orderkey", "l_linenumber", pip.alias("pip"), tk.round_to_pip(F.col("l_extendedprice") / F.col("l_quantity"), pip).alias("price")))


@query("l3_l4_named_levels", sql("""SELECT instrument, idx, level, price, round(coalesce(bb_mid, sma_20), 6) AS mid FROM (
    UNPIVOT (SELECT instrument, idx, last_close, sma_10, sma_20, sma_50, sma_100, sma_200, bb_mid AS bb_middle, bb_upper_1, bb_upper_2, bb_lower_1, bb_lower_2,
        high_n, low_n FROM hsnap) ON COLUMNS(* EXCLUDE (instrument, idx)) INTO NAME level VALUE price)
    JOIN (SELECT instrument, idx, bb_mid, sma_20 FROM hsnap) USING (instrument, idx)""", "hsnap"))
def named_levels(spark, sf):
    rows = hourly_labels(spark, sf).select("instrument", "idx", F.explode(tk.named_levels()).alias("level", "price"), tk.mid_level().alias("mid"))
    return out(rows.withColumn("level", F.when(F.col("level") == "bb_mid", "bb_middle").otherwise(F.col("level"))))


def _decided(spark, sf):
    return outcomes.decide(hourly_labels(spark, sf), PAPER)


_NOTE = """CASE WHEN side <> 'none' THEN '--no-llm; ch7 geometry: ' || side || ' entry=last_close stop=' || CASE side WHEN 'long' THEN 'low_n' ELSE 'high_n' END
    || ' buffer=10pip target=2R' WHEN play_class = 'breakout_watch' THEN '--no-llm; ch7 geometry: breakout_watch, no ticket'
    ELSE '--no-llm; ch7 geometry: no ticket' END"""
_TICKET = "round(e, 6) AS entry, round(s, 6) AS stop, round(target, 6) AS target"
_NONE = "CASE WHEN side <> 'none' THEN round(e, 6) END AS entry, CASE WHEN side <> 'none' THEN round(s, 6) END AS stop, round(target, 6) AS target"


@query("l5_l6_l7_l8_l9_l16_tickets", outer("tickets", f"instrument, idx, play_class, side, {_NONE}, {_NOTE} AS notes"))
def tickets(spark, sf):
    rows = _decided(spark, sf).select("instrument", "idx", *[F.col(f"proposal.{c}").alias(c) for c in ("play_class", "side", "entry", "stop", "target", "notes")])
    return out(rows)


@query("l10_l11_l13_l14_l15_gate", outer("tickets", """instrument, idx, CASE WHEN side <> 'none' THEN 'pending_exec' ELSE 'wait' END AS action,
    CASE WHEN trend_waning THEN 'trend_waning: do not aggress' WHEN side = 'none' THEN 'missing side, entry, stop' ELSE '' END AS reasons,
    CASE WHEN side <> 'none' THEN round((target - e) / (e - s), 6) END AS r_planned,
    CASE WHEN side <> 'none' THEN round(10000.0::DOUBLE * 0.02::DOUBLE / abs(e - s), 6) END AS size_units,
    CASE WHEN side <> 'none' THEN round(abs(e - s), 6) END AS stop_distance"""))
def gate(spark, sf):
    risk = F.col("risk")
    return out(
        _decided(spark, sf).select(
            "instrument", "idx", risk["action"].alias("action"), F.array_join(risk["reasons"], "; ").alias("reasons"),
            *[risk[c].alias(c) for c in ("r_planned", "size_units", "stop_distance")],
        )
    )


@query("l14_gate_over_cap", outer("tickets", """instrument, idx, side <> 'none' AND NOT trend_waning AS measured,
    CASE WHEN trend_waning THEN 'trend_waning: do not aggress' WHEN side = 'none' THEN 'missing side, entry, stop'
        ELSE 'open risk 0.05 + new 0.02 > cap 0.06' END AS reasons"""))
def gate_over_cap(spark, sf):
    """Every ticket fails the exposure cap when five percent is already at risk."""
    risk = F.col("risk")
    decided = outcomes.decide(hourly_labels(spark, sf), tk.Goal(mode="paper", open_risk_fraction=0.05))
    return out(decided.select("instrument", "idx", risk["size_units"].isNotNull().alias("measured"), F.array_join(risk["reasons"], "; ").alias("reasons")))


_CAND = "instrument, entry_idx, epoch(entry_ts)::BIGINT AS entry_ts, side, play_class, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target"
_EXIT = "exit_idx, epoch(exit_ts)::BIGINT AS exit_ts, round(exit_price, 6) AS exit_price, exit_status, r_realized"
_TRADE = ("instrument", "entry_idx", "entry_ts", "side", "play_class", "entry", "stop", "target")
_CLOSED = (*_TRADE, "exit_idx", "exit_ts", "exit_price", "exit_status", "r_realized")


@query("b2_entry_candidates", outer("cands", _CAND))
def entry_candidates(spark, sf):
    return out(outcomes.entry_candidates(hourly_labels(spark, sf), KEYS), *_TRADE)


def _exits(spark, sf):
    return outcomes.resolve_exits(outcomes.entry_candidates(hourly_labels(spark, sf), KEYS), hourly(spark, sf), KEYS)


@query("b1_b3_first_touch_exits", outer("exits", f"{_CAND}, {_EXIT}"))
def first_touch_exits(spark, sf):
    return out(_exits(spark, sf), *_CLOSED)


def _trades(spark, sf):
    return outcomes.walk_trades(hourly_labels(spark, sf), hourly(spark, sf), KEYS).persist()


@query("b4_sequential_trades", outer("taken", f"{_CAND}, {_EXIT}"))
def sequential_trades(spark, sf):
    return out(_trades(spark, sf), *_CLOSED)


# Eight digits hold every unit price of the suppliers that ends at all: no rounding of a printed tie.
@query("b4_supplier_trades", outer("d_taken", f"{_CAND}, {_EXIT}".replace(", 6)", ", 8)")))
def supplier_trades(spark, sf):
    bars = stored_once(daily(spark, sf).select(*KEYS, "idx", "ts", "high", "low", "close"), "daily-bars")
    return out(outcomes.walk_trades(walk.label_steps(bars, KEYS, LOOKBACK), bars, KEYS), *_CLOSED, digits=8)


@query("l12_expectancy", sql("""SELECT instrument, trades, round(win_rate, 6) AS win_rate, round(avg_win_r, 6) AS avg_win_r, round(avg_loss_r, 6) AS avg_loss_r,
    round(win_rate * avg_win_r - (1 - win_rate) * avg_loss_r, 6) AS expectancy FROM (
    SELECT instrument, count(*) AS trades, avg((r_realized > 0)::INT) AS win_rate, coalesce(avg(r_realized) FILTER (WHERE r_realized > 0), 0) AS avg_win_r,
        coalesce(avg(-r_realized) FILTER (WHERE r_realized <= 0), 0) AS avg_loss_r FROM taken GROUP BY 1)""", "taken"))
def expectancy(spark, sf):
    return out(outcomes.trade_expectancy(_trades(spark, sf), ["instrument"]))


# Journal ------------------------------------------------------------------------


def _runs(spark, sf):
    return journal.run_rows(_decided(spark, sf), KEYS, PAPER, batch=1).persist()


@query("s12_journal_runs", outer("tickets", """md5(instrument || '|H1|' || idx) AS run_id, epoch(ts)::BIGINT AS ts, instrument,
    CASE WHEN side <> 'none' THEN 'pending_exec' ELSE 'wait' END AS action, 'paper' AS mode, idx AS line"""))
def journal_runs(spark, sf):
    return out(_runs(spark, sf), "run_id", "ts", "instrument", "action", "mode", "line")


@query("s12_pending_fills", outer("cands", f"{_ID} AS run_id, 'pending' AS status, epoch(entry_ts)::BIGINT AS ts, 'queued by orchestrator' AS note"))
def pending_fills(spark, sf):
    return out(journal.pending_fills(_runs(spark, sf)), "run_id", "status", "ts", "note")


@query("j1_get_run", sql("SELECT md5('click|H1|' || idx) AS run_id, instrument, regime, side FROM tickets WHERE instrument = 'click' AND idx = 300", "tickets"))
def get_run(spark, sf):
    found = journal.records(journal.get_run(_runs(spark, sf), hashlib.md5(b"click|H1|300").hexdigest()))
    return out(found.select("run_id", "instrument", F.col("regime.regime").alias("regime"), F.col("proposal.side").alias("side")))


@query("j2_list_runs", sql("""SELECT instrument, idx AS line, action FROM (SELECT *, CASE WHEN side <> 'none' THEN 'pending_exec' ELSE 'wait' END AS action,
    md5(instrument || '|H1|' || idx) AS run_id FROM tickets) WHERE action = 'wait' ORDER BY idx DESC, run_id DESC LIMIT 50""", "tickets"))
def list_runs(spark, sf):
    return out(journal.list_runs(_runs(spark, sf), 50, action="wait"), "instrument", "line", "action")


@query("j3_list_pending", outer("cands", f"{_ID} AS run_id, instrument, entry_idx AS line"))
def list_pending(spark, sf):
    runs = _runs(spark, sf)
    return out(journal.list_pending(runs, journal.pending_fills(runs)), "run_id", "instrument", "line")


@query("j4_j7_filled_pending", outer("cands", f"{_ID} AS run_id, 'filled_sim' AS status, round(entry, 6) AS fill_price, 'stub: zero slippage; no broker' AS note"))
def filled_pending(spark, sf):
    runs = _runs(spark, sf)
    fills = journal.pending_fills(runs)
    return out(journal.record_fills(fills, journal.resolve_pending(runs, fills)), "run_id", "status", "fill_price", "note")


@query("j4_two_updates", outer("cands", f"{_ID} AS run_id, 'filled_sim' AS status, round(entry, 6) AS fill_price, 'second' AS note"))
def two_updates(spark, sf):
    """Two updates of every pending run in one batch: its row stays one, and the later update holds."""
    runs = _runs(spark, sf)
    fills = journal.pending_fills(runs)
    second = journal.resolve_pending(runs, fills).withColumn("note", F.lit("second"))
    first = second.withColumns({"note": F.lit("first"), "fill_price": F.lit(0.0), "line": F.col("line") - 1})
    return out(journal.record_fills(fills, first.unionByName(second)), "run_id", "status", "fill_price", "note")


@query("j5_recorded_exits", outer("exits", f"{_ID} AS run_id, 'filled_sim' AS status, round(entry, 6) AS fill_price, exit_status, round(exit_price, 6) AS exit_price, r_realized, 'walk exit ' || exit_status AS note"))
def recorded_exits(spark, sf):
    runs = _runs(spark, sf)
    pending = journal.pending_fills(runs)
    fills = journal.record_fills(pending, journal.resolve_pending(runs, pending))
    exits = _exits(spark, sf).select(
        journal.run_id(KEYS, "entry_idx").alias("run_id"), *journal.EXIT_COLUMNS, F.concat(F.lit("walk exit "), "exit_status").alias("note")
    )
    updated, _ = journal.record_exits(fills, exits)
    return out(updated, "run_id", "status", "fill_price", "exit_status", "exit_price", "r_realized", "note")


@query("j5_exits_without_fill", sql(f"SELECT {_ID} AS run_id, exit_status FROM exits WHERE side = 'short'", "exits"))
def exits_without_fill(spark, sf):
    """Only long candidates are filled, so every short exit is rejected."""
    exits = _exits(spark, sf).withColumns({"run_id": journal.run_id(KEYS, "entry_idx"), "note": F.lit("")}).persist()
    fills = exits.filter(F.col("side") == "long").select(
        "run_id", F.lit("filled_sim").alias("status"), F.col("entry").alias("fill_price"), F.col("entry_ts").alias("ts"), "note",
        *[F.lit(None).cast(t).alias(c) for c, t in journal.EXIT_COLUMNS.items()], F.lit(1).alias("batch"), F.col("entry_idx").alias("line"),
    )
    return out(journal.record_exits(fills, exits)[1], "run_id", "exit_status")


@query("j6_j8_latest_fills", outer("cands", f"{_ID} AS run_id, CASE side WHEN 'long' THEN 'rejected' ELSE 'pending' END AS status, NULL::VARCHAR AS exit_status"))
def latest_fills(spark, sf):
    """An old table without exit columns plus a later batch for long candidates."""
    runs = _runs(spark, sf)
    old = journal.pending_fills(runs).drop(*journal.EXIT_COLUMNS)
    later = journal.list_pending(journal.records(runs), old).filter(F.col("proposal.side") == "long").select(
        "run_id", F.lit("rejected").alias("status"), F.lit(None).cast("double").alias("fill_price"), "ts", F.lit("late").alias("note"),
        F.lit(2).cast("bigint").alias("batch"), "line",
    )
    return out(journal.latest_fills(journal.append_fills(old, later)), "run_id", "status", "exit_status")


@query("j9_f12_run_summary", outer("tickets", """md5(instrument || '|H1|' || idx) AS run_id, instrument, regime, trend_waning, side,
    CASE WHEN side <> 'none' THEN round(s, 6) END AS stop, round(target, 6) AS target"""))
def run_summary(spark, sf):
    return out(journal.run_summary(_runs(spark, sf)), "run_id", "instrument", "regime", "trend_waning", "side", "stop", "target")


@query("j10_walk_journal", outer("taken", f"{_ID} AS run_id, round(entry, 6) AS fill_price, epoch(entry_ts)::BIGINT AS ts, exit_status, r_realized, 'pending_exec' AS action, 'filled_sim' AS status"))
def walk_journal(spark, sf):
    runs, fills = journal.walk_entries(_trades(spark, sf), KEYS, _decided(spark, sf), PAPER)
    joined = fills.join(runs.select("run_id", "action"), "run_id")
    return out(joined, "run_id", "fill_price", "ts", "exit_status", "r_realized", "action", "status")


@query("j11_stored_tickets", outer("cands", f"""{_ID} AS run_id, CASE entry_idx % 2 WHEN 0 THEN 'OTHER' ELSE instrument END AS instrument,
    CASE entry_idx % 2 WHEN 0 THEN 'D' ELSE 'H1' END AS granularity, side, round(entry, 6) AS entry, epoch(entry_ts)::BIGINT AS at_ts"""))
def stored_tickets(spark, sf):
    runs = _runs(spark, sf)
    wanted = runs.filter(F.col("action") == "pending_exec").select(
        "run_id", F.when(F.col("line") % 2 == 0, "OTHER").alias("instrument"), F.lit("D").alias("granularity"), F.lit("none").alias("side"),
        F.lit(None).cast("timestamp").alias("at_ts"),
    )
    return out(journal.stored_tickets(runs, wanted)[0], "run_id", "instrument", "granularity", "side", "entry", "at_ts")


@query("j11_ticket_rejects", outer("tickets", """md5(instrument || '|H1|' || idx) AS run_id, 'run has no complete ticket (entry/stop/target)' AS reason""") + " WHERE side = 'none'")
def ticket_rejects(spark, sf):
    runs = _runs(spark, sf)
    blank = F.lit(None).cast("string")
    wanted = runs.select("run_id", blank.alias("instrument"), blank.alias("granularity"), blank.alias("side"), F.lit(None).cast("timestamp").alias("at_ts"))
    return out(journal.stored_tickets(runs, wanted)[1], "run_id", "reason")


# Annotations ----------------------------------------------------------------------


def _ann(df):
    return out(df.drop("granularity"))


def _recent(spark, sf):
    bars = hourly(spark, sf)
    return plot_series(bars, KEYS, bars.groupBy(*KEYS).agg(F.count("*").alias("bar_count")))


def _segments_sql(points: str, series: str = "instrument") -> str:
    """Every second of (instrument, ..., idx, t, value) and the last, joined to lines."""
    return f"""SELECT {series}, row_number() OVER k - 1 AS segment, t AS t1, value AS p1, lead(t) OVER k AS t2, lead(value) OVER k AS p2 FROM (
        SELECT *, min(idx) OVER (PARTITION BY {series}) AS f, max(idx) OVER (PARTITION BY {series}) AS l FROM ({points}) WHERE value IS NOT NULL)
        WHERE (idx - f) % 2 = 0 OR idx = l WINDOW k AS (PARTITION BY {series} ORDER BY idx) QUALIFY t2 IS NOT NULL"""


@query("o1_polylines", sql(f"""SELECT instrument, segment, t1, round(p1, 6) AS p1, t2, round(p2, 6) AS p2 FROM ({_segments_sql("SELECT instrument, idx, epoch(ts)::BIGINT AS t, sma_20 AS value FROM hi")})""", "hi"))
def polylines(spark, sf):
    """SMA-20 of whole series as one line each, joined over the seams of blocks of 64 joints."""
    points = indicator_blocks(hourly(spark, sf), KEYS, columns=["sma_20"]).filter("core").withColumn("value", F.col("sma_20"))
    return out(ann.polyline(points, KEYS, block=64), "instrument", "segment", "t1", "p1", "t2", "p2")


@query("o2_formation_annotations")
def formation_annotations(spark, sf):
    return _ann(ann.formation_annotations(patterns.analyze_windows(tiles(hourly(spark, sf), TILE, stride=STRIDE), TILES), TILES))


_OVERLAYS = {f"sma_{p}": f"sma{p}" for p in SMA} | {f"bb_{b}": f"bb.{b}" for b in ("upper_2", "upper_1", "lower_1", "lower_2")}
_LAST_LABEL = "row_number() OVER (PARTITION BY instrument ORDER BY idx DESC) = 1"


@query("o3_regime_annotations", sql(f"""SELECT instrument, 'regime.' || series || '.' || segment AS name, 'trend' AS type, t1, round(p1, 6) AS p1, t2, round(p2, 6) AS p2, NULL::VARCHAR AS text
    FROM ({_segments_sql("SELECT instrument, idx, epoch(ts)::BIGINT AS t, unnest([" + ", ".join(f"'{n}'" for n in _OVERLAYS.values()) + "]) AS series, unnest([" + ", ".join(_OVERLAYS) + "]) AS value FROM (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY idx DESC) <= 80)", "instrument, series")})
    UNION ALL SELECT instrument, 'regime.' || unnest(['high_n', 'low_n']), 'hline', NULL, unnest([round(high_n, 6), round(low_n, 6)]), NULL, NULL, NULL FROM (SELECT * FROM hlab QUALIFY {_LAST_LABEL})
    UNION ALL SELECT instrument, 'regime.label', 'label', NULL, NULL, NULL, NULL, 'regime=' || regime || ' ADX=' || adx || CASE WHEN adx_rising THEN ' rising' WHEN adx_slope IS NOT NULL THEN ' falling' ELSE ' ?' END
        || ' perfect_order=' || coalesce(ma_perfect_order, 'None') || ' plays=' || play_class FROM (SELECT * FROM hlab QUALIFY {_LAST_LABEL})""", "hi", "hlab"))
def regime_annotations(spark, sf):
    good, _ = last_snapshots(hourly(spark, sf), KEYS, LOOKBACK)
    return _ann(ann.regime_annotations(classify(good), _recent(spark, sf), KEYS))


@query("o4_o5_walk_annotations", sql("""
    SELECT instrument, 'walk.run.' || run AS name, 'rectangle' AS type, epoch(start_ts)::BIGINT AS t1, low AS p1,
        CASE WHEN end_ts = start_ts THEN epoch(start_ts)::BIGINT + 1 ELSE epoch(end_ts)::BIGINT END AS t2, high AS p2,
        CASE WHEN trend_waning THEN 'waning' WHEN regime = 'trend' AND direction IS NOT NULL THEN 'trend_' || direction WHEN regime = 'range' THEN 'range' ELSE 'other' END AS text FROM runs
    UNION ALL SELECT instrument, 'walk.run.' || run || '.text', 'text', epoch(start_ts)::BIGINT, high, NULL, NULL,
        CASE WHEN trend_waning THEN regime || '/waning' WHEN direction IS NOT NULL THEN regime || '/' || direction ELSE regime END FROM runs
    UNION ALL SELECT instrument, 'walk.watch.' || idx || unnest(['', '.text']), unnest(['arrow', 'text']), epoch(ts)::BIGINT, high, NULL, NULL,
        unnest([NULL, 'p=' || coalesce(printf('%.2f', p_hat), 'na') || '  i=' || coalesce(printf('%.2f', instability::DOUBLE), 'na')])
        FROM (SELECT * REPLACE (CASE WHEN n_hist >= 10 THEN (hits * 10000 // n_hist + (2 * (hits * 10000 % n_hist) + hits * 10000 // n_hist % 2 > n_hist)::INT)::DOUBLE / 10000 END AS p_hat) FROM scored)
        WHERE p_hat >= 0.5 OR instability >= 0.6""", "runs", "scored"))
def walk_annotations(spark, sf):
    result = walk.walk_and_collapse(hourly(spark, sf), KEYS, LOOKBACK)
    rows = ann.walk_annotations(result.runs, result.steps, result.summary, KEYS)
    return _ann(rows.filter(F.col("type") != "label"))


@query("o4_walk_summary_line", sql("""SELECT instrument, 'walk.label' AS name, 'label' AS type, NULL::BIGINT AS t1, NULL::DOUBLE AS p1, NULL::BIGINT AS t2, NULL::DOUBLE AS p2,
    'walk steps=' || steps || ' runs=' || runs || ' ' || counts || ' p_hat=' || coalesce(last_p_hat::VARCHAR, 'na') || ' brier=' || coalesce(brier::VARCHAR, 'na') || ' show=both' AS text
    FROM (SELECT instrument, sum(n)::BIGINT AS steps, string_agg(regime || '=' || n, ' ' ORDER BY regime) AS counts FROM (SELECT instrument, regime, count(*) AS n FROM scored GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT instrument, round_even(avg(eval_brier), 4) AS brier FROM scored GROUP BY 1) USING (instrument)
    JOIN (SELECT instrument, p_hat AS last_p_hat FROM scored QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY pos DESC) = 1) USING (instrument)
    JOIN (SELECT instrument, count(*) AS runs FROM runs GROUP BY 1) USING (instrument)""", "scored", "runs"))
def walk_summary_line(spark, sf):
    result = walk.walk_and_collapse(hourly(spark, sf), KEYS, LOOKBACK)
    return _ann(ann.walk_annotations(result.runs, result.steps, result.summary, KEYS).filter(F.col("type") == "label"))


@query("o6_trade_annotations", sql("""
    SELECT instrument, 'trade.' || entry_idx || '.' || unnest(['arrow', 'side', 'stop', 'target', 'path']) AS name, unnest(['arrow', 'text', 'trend', 'trend', 'trend']) AS type,
        t1, round(unnest([entry, entry, stop, target, entry]), 6) AS p1, unnest([NULL, NULL, t2, t2, t2]) AS t2, round(unnest([NULL, NULL, stop, target, exit_price]), 6) AS p2,
        unnest([NULL, side, NULL, NULL, CASE WHEN r_realized > 0 THEN 'won' ELSE 'lost' END]) AS text
    FROM (SELECT *, epoch(entry_ts)::BIGINT AS t1, epoch(exit_ts)::BIGINT + (exit_ts = entry_ts)::BIGINT AS t2 FROM taken)""", "taken"))
def trade_annotations(spark, sf):
    return _ann(ann.trade_annotations(_trades(spark, sf), KEYS))


@query("o7_ticket_annotations", outer("cands", """instrument, entry_idx, 'ticket.' || unnest(['entry', 'stop', 'target', 'time', 'time.arrow', 'time.text']) AS name,
    unnest(['hline', 'hline', 'hline', 'vline', 'arrow', 'text']) AS type, unnest([NULL, NULL, NULL, epoch(entry_ts)::BIGINT, epoch(entry_ts)::BIGINT, epoch(entry_ts)::BIGINT]) AS t1,
    round(unnest([entry, stop, target, NULL, entry, entry]), 6) AS p1, unnest([NULL, NULL, NULL, NULL, side, strftime(entry_ts, '%Y-%m-%d %H:%M') || ' UTC']) AS text""") + " WHERE least(entry, stop, target) > 0")
def ticket_annotations(spark, sf):
    chosen = outcomes.entry_candidates(hourly_labels(spark, sf), KEYS).withColumn("at_ts", F.col("entry_ts"))
    rows = ann.ticket_annotations(chosen, [*KEYS, "entry_idx"], ticket_stamp_seconds(F.unix_seconds("entry_ts")))
    return _ann(rows.filter(F.col("type") != "label").drop("t2", "p2"))


@query("o8_annotation_problems", outer("hb", """instrument, CASE volume % 4 WHEN 0 THEN 'Unsupported object type ''circle''' WHEN 1 THEN 'object is missing ''name'''
    WHEN 2 THEN 'hline requires p1' END AS reason, count(*) AS n""") + " GROUP BY ALL")
def annotation_problems(spark, sf):
    kind = F.col("volume") % 4
    rows = hourly(spark, sf).select(
        "instrument",
        F.when(kind == 0, "circle").when(kind == 3, "Trend ").otherwise("hline").alias("type"),
        F.when(kind == 1, " ").otherwise("x").alias("name"),
        F.when(kind != 2, F.col("close")).alias("p1"),
        F.unix_seconds("ts").alias("t1"),
    )
    return out(rows.groupBy("instrument", ann.annotation_problem().alias("reason")).agg(F.count("*").alias("n")))
