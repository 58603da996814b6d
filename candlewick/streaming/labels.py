"""Streaming labels: each new bar of a series is labelled from its last ``lookback`` bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from candlewick.operators.indicators import FRAME_COLUMNS, RECURSIVE_COLUMNS, edge_snapshots, rounded_snapshot
from candlewick.operators.regime import classify

_PRICES = ("open", "high", "low", "close")
_BAR = StructType([StructField("micros", LongType()), *[StructField(c, DoubleType()) for c in _PRICES]])
#: Bars that one call of the label kernel takes.
STEP = 4096

UNTIMED, LATE, REPEATED = "bar without a time", "not after the last labelled bar", "repeats a waiting bar"


def ready_session(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Labeller(StatefulProcessor):
    """State of a series: how far it is, its last ``lookback - 1`` labelled bars, and the bars that wait for its clock."""

    def __init__(self, keys: list[str], columns: list[str], lookback: int, delay: int, idle: int | None):
        self.keys, self.columns, self.lookback, self.delay, self.idle = keys, columns, lookback, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seen long, last long, clock long")
        self.history = handle.getListState("history", "high double, low double, close double")
        self.waiting = handle.getListState("waiting", _BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, last, clock = self.place.get() or (0, None, None)
        parts, late = [], []
        for chunk in rows:
            timed = chunk["micros"].notna()
            late.append(self._late(chunk[~timed], UNTIMED))
            chunk = chunk[timed]
            if len(chunk):
                micros = chunk["micros"].to_numpy(float)  # exact: below 2 ** 53
                newest = int(micros.max())
                clock = newest if clock is None else max(clock, newest)
                bars = chunk["close"].notna().to_numpy()  # a row without a price only moves the clock
                behind = bars & (micros <= last) if last is not None else np.zeros(len(bars), bool)
                late.append(self._late(chunk[behind], LATE))
                parts.append(np.column_stack([micros, chunk[list(_PRICES)].to_numpy(float)])[bars & ~behind])
        old = np.array(list(self.waiting.get()), float).reshape(-1, 5)
        # Of equal times the one that waited longest stays; inside a batch the least by its prices.
        fresh = np.concatenate(parts) if parts else old[:0]
        fresh = fresh[np.lexsort(fresh.T[::-1])] if len(fresh) else fresh
        every = np.concatenate([old, fresh])
        order = np.argsort(every[:, 0], kind="stable")
        every = every[order]
        first = np.append(True, np.diff(every[:, 0]) != 0)[: len(every)]
        late.append(self._late(self._frame(key, every[~first]), REPEATED))
        yield from (x for x in late if len(x))
        yield from self._release(key, every[first], seen, last, clock, None if clock is None else clock - self.delay)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A series that has been silent labels what waits."""
        seen, last, clock = self.place.get() or (0, None, None)
        yield from self._release(key, np.array(list(self.waiting.get()), float).reshape(-1, 5), seen, last, clock, clock)

    def _release(self, key, bars: np.ndarray, seen: int, last: int | None, clock: int | None, until: int | None) -> Iterator[pd.DataFrame]:
        ready = int(np.searchsorted(bars[:, 0], until, "right")) if until is not None else 0
        history = np.array(list(self.history.get()), float).reshape(-1, 3)
        for at in range(0, ready, STEP):
            step = bars[at : min(at + STEP, ready)]
            columns = np.concatenate([history, step[:, 2:5]])
            seen, history = seen + len(step), columns[-(self.lookback - 1) :]
            edges = np.arange(max(self.lookback - 1, len(columns) - len(step)), len(columns))
            if len(edges):
                rows = self._frame(key, step[-len(edges) :]).assign(idx=range(seen - len(edges), seen), reason=None)
                yield rows.assign(**edge_snapshots(*columns.T, edges, self.lookback))[self.columns]
        if ready:
            last = int(bars[ready - 1, 0])
            self.history.put([tuple(map(float, x)) for x in history])
        self.place.update((seen, last, clock))
        if len(bars) > ready:
            self.waiting.put([(int(x[0]), *map(float, x[1:])) for x in bars[ready:]])
        else:
            self.waiting.clear()

    def _frame(self, key, bars: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(bars) for k, v in zip(self.keys, key)}, "micros": bars[:, 0].astype(np.int64), **dict(zip(_PRICES, bars[:, 1:5].T))})

    def _late(self, rows: pd.DataFrame, reason: str) -> pd.DataFrame:
        return rows.assign(reason=reason).reindex(columns=self.columns)

    def close(self) -> None:
        pass


def stream_labels(bars: DataFrame, keys: Sequence[str], lookback: int = 250, delay_seconds: int = 0, idle_seconds: int | None = None) -> DataFrame:
    """Classified rows of a stream of complete bars, in append mode, and bars that came too late.

    Every series has a clock, its newest time seen. A bar is labelled, in time order, once the clock is
    ``delay_seconds`` past it, so that bars may arrive out of order by that much; rows without
    a close only move the clock. With ``idle_seconds`` a silent series labels what waits. Bars that cannot be
    labelled come out as rows with a ``reason`` (null for labels): without a time, not after
    the last labelled bar, or of the time of a bar that waits. Times have microseconds.
    """
    keys, spark = list(keys), bars.sparkSession
    ready_session(spark)
    fields = {f.name: f for f in bars.schema.fields}
    output = StructType(
        [*[fields[k] for k in keys], StructField("micros", LongType()), StructField("idx", LongType()), StructField("reason", StringType())]
        + [StructField(c, DoubleType()) for c in (*_PRICES, *FRAME_COLUMNS, *RECURSIVE_COLUMNS)]
    )
    processor = Labeller(keys, output.names, lookback, delay_seconds * 1_000_000, None if idle_seconds is None else idle_seconds * 1000)
    mode = "None" if idle_seconds is None else "ProcessingTime"
    narrow = bars.select(*keys, F.unix_micros("ts").alias("micros"), *[F.col(c).cast("double").alias(c) for c in _PRICES])
    raw = narrow.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", mode)
    timed = raw.select(*keys, F.timestamp_micros("micros").alias("ts"), *[c for c in output.names if c not in (*keys, "micros")])
    return classify(rounded_snapshot(timed))
