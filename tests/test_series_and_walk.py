"""Blocks of any size give the same answers; labels use the past only."""

import random

import pytest
from pyspark.sql import functions as F

from candlewick.operators import series, walk
from candlewick.operators.series import index_rows, running_offsets
from tests.fixtures import KEYS, frame, noise, ranging, trend

STEP = (
    "instrument string, granularity string, idx bigint, pos bigint, ts timestamp, high double, low double, regime string, direction string,"
    " trend_waning boolean, confidence double, ma_perfect_order string, trend_x_count int, range_x_count int, adx double, adx_slope double, adx_rising boolean"
)


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(series.halo_blocks, "__defaults__", (0, "idx", 16, "block"))
    monkeypatch.setattr(series.running_offsets, "__defaults__", (3,))
    monkeypatch.setattr(walk, "STEP_BLOCK", 8)


def collected(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def random_steps(spark, n=150, seed=3):
    rng, rows = random.Random(seed), []
    for k in ("A", "B"):
        for i in range(n):
            regime = rng.choice(["trend", "range", "mixed"])
            rows.append((
                k, "D", i + 39, i, None, 1.0 + i, 0.5, regime, rng.choice(["up", "down", None]), regime == "mixed" and rng.random() < 0.3,
                rng.random(), rng.choice(["up", None]), rng.randint(0, 6), rng.randint(0, 6), rng.choice([None, 15.0, 20.0, 25.0, 30.0, 40.0]), 0.0, False,
            ))
    return spark.createDataFrame(rows, STEP), rows


def test_index_rows_across_buckets(spark):
    bars = frame(spark, {"A": noise(100), "B": noise(37, 2)})
    again = index_rows(bars.withColumnRenamed("idx", "want"), KEYS, bucket_seconds=3 * 86400)
    assert again.filter("idx <> want").count() == 0 and again.count() == 137


def test_running_offsets_two_levels(spark):
    totals = spark.createDataFrame([("a", b, b + 1) for b in range(0, 50, 2)], "k string, block bigint, n bigint")
    got = {r["block"]: r["n_before"] for r in running_offsets(totals, ["k"], "block", ["n"], fanout=4).collect()}
    assert got == {b: sum(c + 1 for c in range(0, b, 2)) for b in range(0, 50, 2)}


def test_labels_do_not_depend_on_block_size(spark, request):
    bars = frame(spark, {"A": noise(140), "B": noise(90, 5), "C": noise(20, 6)})
    columns = ("instrument", "idx", "regime", "direction", "confidence", "adx", "rsi", "stoch_k", "sma_20", "macd_hist", "high_n")
    want = collected(walk.label_steps(bars, KEYS, 40), *columns)
    request.getfixturevalue("tiny_blocks")
    assert collected(walk.label_steps(bars, KEYS, 40), *columns) == want
    assert len(want) == 101 + 51


def test_labels_are_causal(spark):
    bars = ranging(60) + trend(60, start=1.2)
    changed = bars[:100] + [(9.0, 9.5, 8.5, 9.0)] + bars[101:]
    columns = ("idx", "regime", "direction", "confidence", "adx", "macd_hist")
    label = lambda b: collected(walk.label_steps(frame(spark, {"A": b}), KEYS, 40).filter("idx < 100"), *columns)
    assert label(bars) == label(changed)


def test_trend_and_range_are_recognised(spark):
    bars = frame(spark, {"UP": trend(80), "FLAT": ranging(80)})
    last = {r["instrument"]: r for r in walk.label_steps(bars, KEYS, 60).filter("idx = 79").collect()}
    assert last["UP"]["adx"] > 25 and last["UP"]["direction"] == "up" and last["UP"]["regime"] == "trend"
    assert last["FLAT"]["regime"] != "trend"


def test_short_lookback_is_refused(spark):
    with pytest.raises(ValueError):
        walk.label_steps(frame(spark, {"A": trend(40)}), KEYS, 29)


def test_start_without_warm_up_is_a_reject(spark):
    bars = frame(spark, {"A": trend(60)})
    start = spark.createDataFrame([("A", "D", 10)], "instrument string, granularity string, start_idx bigint")
    assert walk.label_steps(bars, KEYS, 40, start=start).count() == 0
    assert walk.start_rejects(bars, KEYS, start, 40).first()["reason"] == "too few warm-up bars"


def expected_runs(rows):
    runs = []
    for r in rows:
        key = (r[0], r[7], r[8])
        if runs and runs[-1]["key"] == key:
            runs[-1].update(end=r[2], n=runs[-1]["n"] + 1, high=max(runs[-1]["high"], r[5]), waning=runs[-1]["waning"] or r[9])
        else:
            runs.append(dict(key=key, start=r[2], end=r[2], n=1, high=r[5], waning=r[9]))
    return sorted(((*r["key"], r["start"], r["end"], r["n"], r["high"], r["waning"]) for r in runs), key=str)


def test_runs_match_a_loop(spark, tiny_blocks):
    steps, rows = random_steps(spark)
    got = collected(walk.collapse_runs(steps, KEYS), "instrument", "regime", "direction", "start_idx", "end_idx", "bar_count", "high", "trend_waning")
    assert got == expected_runs(rows)


def band(adx):
    return "unknown" if adx is None else "lt20" if adx < 20 else "20_30" if adx <= 30 else "gt30"


@pytest.mark.parametrize("horizon", [1, 5])
def test_probability_matches_a_loop(spark, tiny_blocks, horizon):
    steps, rows = random_steps(spark)
    got = {(r["instrument"], r["pos"]): r for r in walk.attach_change_prob(steps, KEYS, horizon, 3).collect()}
    for name in ("A", "B"):
        own = [r for r in rows if r[0] == name]
        bucket = [(r[7], r[9], band(r[14])) for r in own]
        flip = lambda a, b: a[7] != b[7] or (a[7] == "trend" and a[8] != b[8])
        p = []
        for i in range(len(own)):
            past = [j for j in range(i - horizon + 1) if bucket[j] == bucket[i]]
            hits = sum(flip(own[j], own[j + horizon]) for j in past)
            p.append(round(hits / len(past), 4) if len(past) >= 3 else None)
            r = got[name, i]
            assert (r["n_hist"], r["p_hat"]) == (len(past), p[-1])
            assert r["eval_p_hat"] == (p[i - horizon] if i >= horizon else None)
            assert r["eval_changed"] == (flip(own[i - horizon], own[i]) if i >= horizon else None)


def test_unknown_outcomes_do_not_leak(spark):
    steps, rows = random_steps(spark)
    changed = spark.createDataFrame([r if r[3] < 120 else (*r[:7], "trend", "up", False, *r[10:]) for r in rows], STEP)
    before = lambda df: collected(walk.attach_change_prob(df, KEYS).filter("pos < 120"), "instrument", "pos", "n_hist", "p_hat")
    assert before(steps) == before(changed)


def test_fold_and_kernel_agree(spark):
    from candlewick.operators.indicators import last_snapshots, walk_snapshots

    bars = frame(spark, {"A": noise(60), "B": noise(60, 9)})
    columns = ("instrument", "sma_20", "bb_upper_2", "rsi", "adx", "plus_di", "adx_slope", "macd_signal", "macd_hist", "stoch_d", "bb_zone")
    folded, rejects = last_snapshots(bars, KEYS, 50)
    for a, b in zip(collected(folded, *columns), collected(walk_snapshots(bars, KEYS, 50).filter("idx = 59"), *columns)):
        assert all(x == y or abs(x - y) < 2e-6 for x, y in zip(a[1:-1], b[1:-1])) and a[-1] == b[-1]
    assert rejects.count() == 0
    assert last_snapshots(bars.filter("idx < 20"), KEYS)[1].first()["reason"] == "need at least 30 bars; got 20"
    bad = bars.withColumn("low", F.when(F.col("idx") == 55, 99.0).otherwise(F.col("low")))
    assert {r["reason"] for r in last_snapshots(bad, KEYS)[1].collect()} == {"high < low"}


def test_untimed_rows_are_numbered_and_not_lost(spark):
    rows = [("A", "D", None), ("A", "D", "2024-01-02 00:00:00"), ("A", "D", "2024-01-01 00:00:00"), ("B", "D", None)]
    df = spark.createDataFrame(rows, "instrument string, granularity string, t string").withColumn("ts", F.to_timestamp("t"))
    got = {(r["instrument"], r["t"]): r["idx"] for r in index_rows(df, KEYS).collect()}
    assert got == {("A", None): 0, ("A", "2024-01-01 00:00:00"): 1, ("A", "2024-01-02 00:00:00"): 2, ("B", None): 0}


def test_overlapping_tiles_hold_every_seam(spark):
    df = spark.range(20).select(F.lit("A").alias("instrument"), F.col("id").alias("idx"))
    got = series.tiles(df, 6, stride=2).groupBy("tile").agg(F.count("*").alias("n"), F.max("idx").alias("last")).collect()
    assert sorted(r["tile"] for r in got) == list(range(10)) and all(r["n"] == 6 for r in got if r["tile"] < 8)
    assert series.tiles(df, 6).count() == 20
