"""Exits, selection, gate, patterns and journal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions import tickets as tk
from candlewick.operators import chains, exits, journal, outcomes, patterns
from tests.fixtures import KEYS, frame, noise

CAND = (
    "instrument string, granularity string, entry_idx bigint, entry_ts timestamp, side string, play_class string, entry double, stop double, target double"
)


@pytest.fixture
def small_search(monkeypatch):
    monkeypatch.setattr(exits, "SIZE", 4)
    monkeypatch.setattr(exits, "SPAN", 8)


def exit_of(side, stop, target, bars, i):
    for j in range(i + 1, len(bars)):
        _, high, low, _ = bars[j]
        if side == "long":
            if low <= stop:
                return j, "stop", stop
            if high >= target:
                return j, "target", target
        else:
            if high >= stop:
                return j, "stop", stop
            if low <= target:
                return j, "target", target
    return len(bars) - 1, "window_end", bars[-1][3]


def make(seed=4, n=150):
    rng, series = random.Random(seed), {"A": noise(n, seed), "B": noise(n, seed + 1)}
    rows = []
    for name, bars in series.items():
        for i, (_, _, _, c) in enumerate(bars):
            if rng.random() < 0.6:
                side, d = rng.choice(["long", "short"]), rng.choice([0.005, 0.02, 0.06, 0.5])
                sign = 1 if side == "long" else -1
                rows.append((name, "D", i, None, side, "fade_range", c, c - sign * d, c + sign * 2 * d))
    return series, rows


def test_exits_and_selection_match_a_loop(spark, small_search):
    series, rows = make()
    trades = outcomes.resolve_exits(spark.createDataFrame(rows, CAND), frame(spark, series), KEYS).persist()
    got = {(r["instrument"], r["entry_idx"]): (r["exit_idx"], r["exit_status"], r["exit_price"]) for r in trades.collect()}
    want = {(r[0], r[2]): exit_of(r[4], r[7], r[8], series[r[0]], r[2]) for r in rows}
    assert got == want
    chosen = one_position({k: x for k, (x, *_) in want.items()})
    for block, fanout in ((8, 2), (8, 64), (4096, 64)):
        picked = chains.select_sequential(trades, KEYS, block, fanout)
        assert {(r["instrument"], r["entry_idx"]) for r in picked.collect()} == chosen


def one_position(exit_at):
    chosen, free = set(), {}
    for name, i in sorted(exit_at):
        if i > free.get(name, -1):
            chosen.add((name, i))
            free[name] = exit_at[name, i]
    return chosen


def test_one_long_series_in_a_tree(spark):
    """One series in 188 blocks: gaps of many blocks, long and short trades, trades of one bar, all entries of a stretch open to its end."""
    rng, at, made = random.Random(8), 0, {}
    while at < 1500:
        made["A", at] = at if rng.random() < 0.1 else at + rng.choice([1, 2, 5, 40, 300])
        at += rng.choice([1, 1, 2, 3, 90])
    made |= {("B", i): 900 for i in range(0, 900, 7)} | {("C", 5): 5}
    rows = [(name, "D", i, x) for (name, i), x in made.items()]
    trades = spark.createDataFrame(rows, "instrument string, granularity string, entry_idx bigint, exit_idx bigint").persist()
    picked = chains.select_sequential(trades, KEYS, block=8, fanout=3)
    assert {(r["instrument"], r["entry_idx"]) for r in picked.collect()} == one_position(made)


def test_first_touch_is_the_first():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 64, 100):
        low, high = rng.normal(size=n), rng.normal(size=n) + 1
        low[rng.random(n) < 0.1] = np.nan
        start = rng.integers(0, n + 1, 200)
        floor, ceiling = rng.normal(size=200) - 2, rng.normal(size=200) + 3
        floor[:5] = -np.inf
        got = exits.first_touch(low, high, start, floor, ceiling)
        for s, f, c, g in zip(start, floor, ceiling, got):
            assert g == next((j for j in range(s, n) if low[j] <= f or high[j] >= c), n)


def test_stop_wins_inside_one_bar(spark):
    row = spark.sql("SELECT 'long' side, 1.22D stop, 1.28D target, 1.30D high, 1.20D low")
    assert row.select(tk.first_exit(*[F.col(c) for c in ("side", "stop", "target", "high", "low")])).first()[0] == "stop"


@pytest.mark.parametrize(
    "name, want", [("EUR_USD", 0.0001), ("usd/jpy", 0.01), ("GBPJPY", 0.01), ("AUDNZD", 0.0001)]
)
def test_pip_size(spark, name, want):
    assert spark.range(1).select(tk.pip_size(F.lit(name))).first()[0] == want


def gate(spark, goal=tk.Goal(mode="paper"), **changes):
    base = dict(side="long", entry=1.27, stop=1.268, target=1.274, play_class="join_trend", waning=False, allowed=["join_trend"]) | changes
    num = lambda v: F.lit(v).cast("double")
    row = spark.range(1).select(
        F.lit(base["waning"]).alias("trend_waning"),
        F.array(*[F.lit(p) for p in base["allowed"]]).alias("allowed_play_classes"),
        F.struct(
            F.lit(base["side"]).alias("side"), F.lit(base["play_class"]).alias("play_class"),
            num(base["entry"]).alias("entry"), num(base["stop"]).alias("stop"), num(base["target"]).alias("target"),
        ).alias("proposal"),
    )
    r = tk.with_verdict(row, goal).select("risk.*").first()
    return r["action"], list(r["reasons"]), r


@pytest.mark.parametrize(
    "changes, reason",
    [
        (dict(waning=True), "trend_waning: do not aggress"),
        (dict(play_class="fade_range"), "play_class 'fade_range' not in allowed_play_classes ['join_trend']"),
        (dict(side="none", entry=None, stop=None), "missing side, entry, stop"),
        (dict(target=None), "missing target (need planned R)"),
        (dict(stop=1.28), "long requires stop below entry"),
        (dict(side="short"), "short requires stop above entry"),
        (dict(target=1.272), "planned R 1.000 < 2.0"),
    ],
)
def test_gate_rules(spark, changes, reason):
    action, reasons, _ = gate(spark, **changes)
    assert action == "wait" and reasons == [reason]


def test_gate_passes_and_caps(spark):
    action, reasons, r = gate(spark, target=1.2741)
    assert (action, reasons) == ("pending_exec", []) and r["size_units"] == pytest.approx(200 / 0.002)
    assert gate(spark, tk.Goal(), target=1.2741)[0] == "log_setup"
    over = gate(spark, tk.Goal(mode="paper", open_risk_fraction=0.05), target=1.2741)
    assert over[0] == "wait" and "cap" in over[1][0]
    assert gate(spark, tk.Goal(balance=0.0), target=1.2741)[1] == ["account_balance must be positive"]


def shoulders(last=None):
    """Peaks 12, 14 and 12.5 at 3, 11 and 19 with troughs at 7 and 15."""
    points = {0: 9.0, 3: 12.0, 7: 10.0, 11: 14.0, 15: 10.2, 19: 12.5, 23: 10.5, 27: 10.6}
    xs, bars = sorted(points), []
    for i in range(28):
        a = max(x for x in xs if x <= i)
        b = min(x for x in xs if x >= i)
        p = points[a] if a == b else points[a] + (points[b] - points[a]) * (i - a) / (b - a)
        bars.append((p, p + 0.1, p - 0.1, p))
    if last is not None:
        bars[-1] = (last, last + 0.1, last - 0.1, last)
    return bars


def stage(spark, bars):
    return patterns.formation(patterns.analysis_windows(frame(spark, {"A": bars}), KEYS), KEYS).first()


def test_head_and_shoulders(spark):
    tentative = stage(spark, shoulders())
    assert tentative["stage"] == "neckline_tentative" and tentative["head"]["idx"] == 11 and tentative["neckline"]["i0"] == 7
    broken = stage(spark, shoulders(last=9.0))
    assert broken["stage"] == "confirmed_break" and broken["min_target"] < broken["neckline"]["price_at_last"]
    assert stage(spark, shoulders()[:9])["stage"] == "left_shoulder"


def test_long_windows_are_whole(spark):
    bars = frame(spark, {"A": noise(6000)})
    window = patterns.analysis_windows(bars, KEYS).first()
    assert window["bar_count"] == 6000 and len(window["pivots"]) == patterns.detect_swings(bars, KEYS).count()



FILL = "run_id string, status string, fill_price double, ts timestamp, note string, exit_status string, exit_price double, exit_ts timestamp, r_realized double, batch bigint, line bigint"


def test_fill_updates_inserts_and_exits(spark):
    fills = spark.createDataFrame([("a", "pending", None, None, "q", None, None, None, None, 1, 1), ("b", "filled_sim", 1.0, None, "", None, None, None, None, 1, 2)], FILL)
    updates = spark.createDataFrame([("a", "filled_sim", 2.0, None, "u", None, None, None, None, 2, 1), ("c", "rejected", None, None, "u", None, None, None, None, 2, 2)], FILL)
    merged = journal.record_fills(fills, updates)
    assert {(r["run_id"], r["status"], r["batch"]) for r in merged.collect()} == {("a", "filled_sim", 1), ("b", "filled_sim", 1), ("c", "rejected", 2)}
    exits = spark.createDataFrame([("b", "stop", 0.9, None, -1.0, "x"), ("c", "stop", 0.9, None, -1.0, "x")], "run_id string, exit_status string, exit_price double, exit_ts timestamp, r_realized double, note string")
    updated, rejects = journal.record_exits(merged, exits)
    assert [r["run_id"] for r in rejects.collect()] == ["c"]
    assert {r["run_id"]: r["exit_status"] for r in updated.collect()} == {"a": None, "b": "stop", "c": None}
    old = fills.drop(*journal.EXIT_COLUMNS)
    assert set(journal.add_exit_columns(old).columns) == set(fills.columns)


def test_sizing_and_expectancy(spark):
    row = spark.range(1).select(
        tk.position_size(F.lit(10000.0), F.lit(0.02), F.lit(0.0), F.lit(1.0)).alias("bad"),
        tk.expectancy(F.lit(0.5), F.lit(2.0), F.lit(1.0)).alias("e"),
        tk.exposure_allows(F.lit(0.04), F.lit(0.02), F.lit(0.06)).alias("ok"),
        tk.r_multiple(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("r"),
    ).first()
    assert (row["bad"], row["e"], row["ok"], row["r"]) == (None, 0.5, True, None)


def test_whole_plans_run(spark):
    from candlewick.plans.decision import decide_latest
    from candlewick.plans.walkforward import walk_forward

    bars = frame(spark, {"EUR_USD": noise(120), "USD_JPY": noise(100, 8, 120.0)})
    frm, to = F.lit("2024-03-01").cast("timestamp"), F.lit("2024-04-20").cast("timestamp")
    result = walk_forward(bars, KEYS, frm, to, lookback=40)
    assert result.summary.count() == 2 and result.steps.agg(F.min("ts")).first()[0].month == 3
    assert result.journal_runs.count() == result.trades.count() == result.journal_fills.count()
    decisions = decide_latest(bars, KEYS)
    assert decisions.runs.count() == 2 and decisions.rejects.count() == 0
