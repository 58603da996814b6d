"""Recurrences of whole series against loops, over many blocks, levels and Arrow batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import recurrences as rec
from tests.fixtures import KEYS, frame, noise


def averaged(values, period, first, decay):
    out = [None] * len(values)
    for i in range(first + period - 1, len(values)):
        out[i] = sum(values[first : i + 1]) / period if i == first + period - 1 else decay * out[i - 1] + (1 - decay) * values[i]
    return out


def strength(closes):
    change = [0.0] + [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = (averaged([max(s * c, 0.0) for c in change], 14, 1, 13 / 14) for s in (1, -1))
    return [None if g is None else (100.0 if g > 0 else 50.0) if v == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / v) for g, v in zip(gain, loss)]


@pytest.fixture
def tiny_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_series_recursions_match_loops(spark, tiny_batches):
    series = {"long": noise(330, 3), "short": noise(13, 4), "one": noise(1, 5), "flat": [(1.0, 1.0, 1.0, 1.0)] * 40, "edge": noise(32, 6)}
    bars = frame(spark, series).withColumn("adx", F.lit("mine"))
    got = {}
    for r in rec.series_recursions(bars, KEYS, block=16, fanout=2).collect():
        got[r.instrument, r.idx] = r
    assert len(got) == sum(map(len, series.values()))
    for name, rows in series.items():
        closes = [c for *_, c in rows]
        fast, slow = averaged(closes, 12, 0, 1 - 2 / 13), averaged(closes, 26, 0, 1 - 2 / 27)
        line = [None if s is None else f - s for f, s in zip(fast, slow)]
        signal = averaged([x or 0.0 for x in line], 9, 25, 0.8)
        for i, want in enumerate(zip(fast, slow, line, signal, strength(closes))):
            r = got[name, i]
            for have, value in zip((r.ema_fast, r.ema_slow, r.macd, r.macd_signal, r.rsi), want):
                assert have == pytest.approx(value, abs=1e-9) if value is not None else have is None
    assert got["flat", 39].rsi == 50.0 and got["flat", 39].adx == 0.0 and got["long", 26].adx is None and got["long", 27].adx is not None


def test_maps_compose_by_doubling():
    rng = np.random.default_rng(1)
    a, b, start = rng.random((50, 2)), rng.random((50, 2)), rng.random(50) < 0.1
    got_a, got_b = rec.composed(a, b, start)
    for i in range(50):
        k = max([j for j in range(i + 1) if start[j] or j == 0])
        x, y = np.ones(2), np.zeros(2)
        for j in range(k, i + 1):
            x, y = a[j] * x, a[j] * y + b[j]
        assert np.allclose(got_a[i], x) and np.allclose(got_b[i], y)


def test_no_rows(spark):
    assert rec.series_recursions(frame(spark, {}), KEYS).count() == 0
