"""Bar builders used by the tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

KEYS = ["instrument", "granularity"]
SCHEMA = (
    "instrument string, granularity string, ts timestamp, idx bigint, open double, high double, low double, close double"
)


def trend(n, step=0.01, start=1.0):
    rows, p = [], start
    for _ in range(n):
        p += step
        half = abs(step) * 0.3 + 0.0005
        rows.append((p, p + half, p - half, p))
    return rows


def ranging(n, level=1.2, amp=0.004):
    rows = []
    for i in range(n):
        c = level + (amp if i % 2 == 0 else -amp)
        rows.append((c, c + amp / 2, c - amp / 2, c))
    return rows


def noise(n, seed=1, start=1.2):
    rng, rows, p = random.Random(seed), [], start
    for _ in range(n):
        p = max(0.2, p + rng.gauss(0, 0.01))
        hi, lo = p + abs(rng.gauss(0, 0.006)), p - abs(rng.gauss(0, 0.006))
        rows.append((round(p, 5), round(hi, 5), round(lo, 5), round(p, 5)))
    return rows


def frame(spark, series: dict):
    day = datetime(2024, 1, 1)
    rows = [
        (name, "D", day + timedelta(days=i), i, *map(float, ohlc)) for name, bars in series.items() for i, ohlc in enumerate(bars)
    ]
    return spark.createDataFrame(rows, SCHEMA)
