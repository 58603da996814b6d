"""Linear recurrences over whole series of any length, by an associative scan.

A step y -> a * y + b composes with the next one to another of its kind. Blocks of rows are composed in
numpy over Arrow batches, block maps in a tree of fixed fan-out, and the state before
each block then enters it as a first row with a = 0: no task holds a series.
Averages that begin with a plain mean are such steps too: a sum first, then a division,
then the usual decay.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from candlewick.operators.indicators import ADX_PERIOD, MACD_FAST, MACD_SIGNAL, MACD_SLOW, ROWS_PER_CALL, RSI_PERIOD
from candlewick.operators.series import halo_blocks
from candlewick.session import stored_once

BLOCK, FANOUT = 2048, 64
_DOUBLES = "array<double>"


def composed(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps (rows x recurrences) composed from the start of each row's stretch up to it, by doubling."""
    a, b, at = a.copy(), b.copy(), np.arange(len(start))
    place = at - np.maximum.accumulate(np.where(start, at, 0))
    step = 1
    while step <= place.max(initial=0):
        rows = np.flatnonzero(place >= step)
        b[rows] += a[rows] * b[rows - step]
        a[rows] *= a[rows - step]
        step *= 2
    return a, b


def _scanned(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, start flags, composed a, composed b); a stretch goes on over the batches' seams."""
    carried: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.stack([batch.column(f"__{side}{i}").to_numpy() for i in range(count)], axis=1) for side in "ab")
        start = batch.column("__start").to_numpy(zero_copy_only=False)
        if carried is not None and not start[0]:
            a[:1], b[:1] = a[:1] * carried[0], a[:1] * carried[1] + b[:1]
        a, b = composed(a, b, start)
        carried = a[-1:].copy(), b[-1:].copy()
        yield batch, start, a, b


def _block_maps(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """(keys, block, a, b): the map of each whole block."""
    schema = StructType([*[rows.schema[c] for c in (*keys, "block")], *[StructField(f"__{s}{i}", DoubleType()) for s in "ab" for i in range(count)]])
    arrow = to_arrow_schema(schema)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of a block that may go on in the next batch
        for batch, start, a, b in _scanned(batches, count):
            if last is not None and start[0]:
                yield last
            at = np.flatnonzero(np.append(start[1:], True))
            made = [pa.array(x[at, i]) for x in (a, b) for i in range(count)]
            found = pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in (*keys, "block")], *made], schema=arrow)
            yield found.slice(0, len(at) - 1)
            last = found.slice(len(at) - 1)
        if last is not None:
            yield last

    maps = rows.mapInArrow(ends, schema)
    return maps.select(*keys, "block", *[F.array(*[F.col(f"__{s}{i}") for i in range(count)]).alias(s) for s in "ab"])


def _after(state: Column, a: Column, b: Column) -> Column:
    return F.zip_with(F.zip_with(state, a, lambda y, k: y * k), b, lambda y, k: y + k)


def states_before(maps: DataFrame, keys: Sequence[str], count: int, fanout: int = FANOUT) -> DataFrame:
    """(keys, block, state): what the recurrences are before each block, from 0 before the first."""
    keys = list(keys)
    largest = maps.agg(F.max("block")).first()[0] or 0
    zeros = F.array(*[F.lit(0.0)] * count)
    ordered = F.array_sort(F.collect_list(F.struct("block", "a", "b")))
    nodes = maps.groupBy(*keys, F.floor(F.col("block") / fanout).alias("node")).agg(ordered.alias("maps"))
    if largest < fanout:
        nodes = nodes.withColumn("state", zeros)
    else:
        nodes = stored_once(nodes, "recurrence-nodes")
        ones = F.array(*[F.lit(1.0)] * count)
        whole = F.aggregate(
            "maps", F.struct(ones.alias("a"), zeros.alias("b")),
            lambda m, n: F.struct(F.zip_with(m["a"], n["a"], lambda x, y: x * y).alias("a"), _after(m["b"], n["a"], n["b"]).alias("b")),
        )
        above = nodes.select(*keys, F.col("node").alias("block"), whole.alias("m")).select(*keys, "block", "m.a", "m.b")
        nodes = nodes.join(states_before(above, keys, count, fanout).withColumnRenamed("block", "node"), [*keys, "node"])
    states = F.aggregate(
        "maps", F.array("state"), lambda seen, m: F.concat(seen, F.array(_after(F.element_at(seen, -1), m["a"], m["b"])))
    )
    placed = F.arrays_zip(F.col("maps.block").alias("block"), F.slice(states, 1, F.size("maps")).alias("state"))
    return nodes.select(*keys, F.explode(placed).alias("s")).select(*keys, "s.block", "s.state")


def affine_scan(
    rows: DataFrame, keys: Sequence[str], maps: Mapping[str, tuple[Column, Column]], block: int = BLOCK, fanout: int = FANOUT
) -> DataFrame:
    """Adds a column per recurrence y(idx) = a * y(idx - 1) + b, with y = 0 before the first row.

    ``rows``: keys, ``idx`` from 0 without gaps, and more; read twice, so pass a stored table. ``maps``
    names a and b of each recurrence, columns that are never null.
    """
    keys, names, count = list(keys), list(maps), len(maps)
    kept = [c for c in rows.columns if c not in names]
    steps = rows.select(
        *kept, F.floor(F.col("idx") / block).alias("block"), (F.col("idx") % block == 0).alias("__start"), F.lit(False).alias("__state"),
        *[m[0].cast("double").alias(f"__a{i}") for i, m in enumerate(maps.values())], *[m[1].cast("double").alias(f"__b{i}") for i, m in enumerate(maps.values())],
    )
    laid = lambda df: df.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "idx")
    thin = steps.select(*keys, "idx", "block", "__start", *[f"__{s}{i}" for s in "ab" for i in range(count)])
    before = states_before(stored_once(_block_maps(laid(thin), keys, count), "recurrence-maps"), keys, count, fanout)
    first = before.select(
        *keys, (F.col("block") * block - 1).cast(rows.schema["idx"].dataType).alias("idx"), "block", F.lit(True).alias("__start"), F.lit(True).alias("__state"),
        *[F.lit(0.0).alias(f"__a{i}") for i in range(count)], *[F.col("state")[i].alias(f"__b{i}") for i in range(count)],
    )
    both = laid(steps.withColumn("__start", F.lit(False)).unionByName(first, allowMissingColumns=True))
    schema = StructType([*[both.schema[c] for c in kept], *[StructField(n, DoubleType()) for n in names], StructField("__state", BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, b in _scanned(batches, count):
            columns = [*[batch.column(c) for c in kept], *[pa.array(b[:, i]) for i in range(count)], batch.column("__state")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return both.mapInArrow(run, schema).filter("not __state").drop("__state")


def seeded(x: Column, first: int, period: int, decay: float) -> tuple[Column, Column]:
    """Steps of an average over ``x`` from index ``first`` on: the mean of ``period`` values, then decay * y + (1 - decay) * x."""
    idx, ready = F.col("idx"), first + period - 1
    a = F.when(idx < ready, 1.0).when(idx == ready, 1.0 / period).otherwise(decay)
    b = F.when(idx < first, 0.0).when(idx < ready, x).when(idx == ready, x / period).otherwise(x * (1.0 - decay))
    return a, b


def ema(x: Column, period: int, first: int = 0) -> tuple[Column, Column]:
    """Exponential average that begins with a plain mean."""
    return seeded(x, first, period, 1.0 - 2.0 / (period + 1))


def wilder(x: Column, period: int, first: int = 1) -> tuple[Column, Column]:
    """Wilder's average, from the second row on unless given."""
    return seeded(x, first, period, (period - 1) / period)


#: Recurrences of the first scan (period, first row) and, over their results, of the second.
_FIRST = {
    "ema_fast": (MACD_FAST, 0), "ema_slow": (MACD_SLOW, 0), "gain": (RSI_PERIOD, 1), "loss": (RSI_PERIOD, 1),
    "range": (ADX_PERIOD, 1), "up": (ADX_PERIOD, 1), "down": (ADX_PERIOD, 1),
}
_SECOND = {"signal": (MACD_SIGNAL, MACD_SLOW - 1), "adx": (ADX_PERIOD, ADX_PERIOD)}
_RESULTS = ("ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "rsi", "plus_di", "minus_di", "adx")


def _decay(name: str, period: int) -> float:
    return 1.0 - 2.0 / (period + 1) if name.startswith("ema") or name == "signal" else (period - 1) / period


def _steps(kinds: Mapping[str, tuple[int, int]], values: Mapping[str, np.ndarray], idx: np.ndarray, core: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``seeded`` in numpy, composed from the start of each block; a row of halo changes nothing."""
    a, b = np.ones((len(idx), len(kinds))), np.zeros((len(idx), len(kinds)))
    for i, (name, (period, first)) in enumerate(kinds.items()):
        x, ready, decay = values[name], first + period - 1, _decay(name, period)
        a[:, i] = np.where(~core | (idx < ready), 1.0, np.where(idx == ready, 1.0 / period, decay))
        b[:, i] = np.where(~core | (idx < first), 0.0, np.where(idx < ready, x, np.where(idx == ready, x / period, x * (1.0 - decay))))
    return composed(a, b, start)


class _Laid:
    """Whole blocks laid end to end: rows, and which of them begin a block and belong to it."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        rows = batch.column("_rows")
        self.batch, lengths = batch, rows.value_lengths().to_numpy()
        flat = rows.flatten()
        self.rows = dict(zip([f.name for f in flat.type], flat.flatten()))
        self.ends = np.cumsum(lengths) - 1
        self.stretch = np.repeat(np.arange(len(lengths)), lengths)
        self.idx = self.rows["idx"].to_numpy()
        self.start = np.zeros(len(self.idx), bool)
        self.start[self.ends - lengths + 1] = True
        self.core = self.idx // size == batch.column("block").to_numpy()[self.stretch]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        high, low, close = (self.rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("high", "low", "close"))
        before = lambda x: np.concatenate([x[:1], x[:-1]])
        change, up, down = close - before(close), high - before(high), before(low) - low
        gap = np.maximum(high - low, np.maximum(np.abs(high - before(close)), np.abs(low - before(close))))
        moves = {
            "gain": np.maximum(change, 0.0), "loss": np.maximum(-change, 0.0), "range": gap,
            "up": np.where((up > down) & (up > 0), up, 0.0), "down": np.where((down > up) & (down > 0), down, 0.0),
        }  # a block's first row is halo, or has no bar before it
        return _steps(_FIRST, {"ema_fast": close, "ema_slow": close} | {k: np.where(self.start, 0.0, v) for k, v in moves.items()}, self.idx, self.core, self.start)

    def after(self, column: str, maps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What the recurrences are at every row, from their states before the blocks."""
        state = self.batch.column(column)
        return maps[0] * state.flatten().to_numpy().reshape(len(state), -1)[self.stretch] + maps[1]

    def levels(self) -> dict[str, np.ndarray]:
        found = dict(zip(_FIRST, self.after("_state", self.first()).T))
        percent = lambda part, whole: np.divide(100.0 * part, whole, out=np.zeros(len(whole)), where=whole != 0)
        plus, minus = percent(found["up"], found["range"]), percent(found["down"], found["range"])
        return found | {"plus": plus, "minus": minus, "signal": found["ema_fast"] - found["ema_slow"], "adx": percent(np.abs(plus - minus), plus + minus)}

    def second(self, levels: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _steps(_SECOND, levels, self.idx, self.core, self.start)

    def results(self) -> dict[str, pa.Array]:
        levels = self.levels()
        signal, adx = self.after("_state2", self.second(levels)).T
        gain, loss, line = levels["gain"], levels["loss"], levels["signal"]
        strength = np.divide(gain, loss, out=np.zeros(len(gain)), where=loss != 0)
        rsi = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), np.where(gain == 0, 0.0, 100.0 - 100.0 / (1.0 + strength)))
        slow, ready, n = MACD_SLOW - 1, MACD_SLOW + MACD_SIGNAL - 2, ADX_PERIOD
        values = {
            "ema_fast": (MACD_FAST - 1, levels["ema_fast"]), "ema_slow": (slow, levels["ema_slow"]), "macd": (slow, line), "macd_signal": (ready, signal),
            "macd_hist": (ready, line - signal), "rsi": (RSI_PERIOD, rsi), "plus_di": (n, levels["plus"]), "minus_di": (n, levels["minus"]), "adx": (2 * n - 1, adx),
        }
        return {k: pa.array(v, mask=self.idx < first) for k, (first, v) in values.items()}


def _laid(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Laid]:
    """The blocks of a partition, about ROWS_PER_CALL rows at a time."""
    for batch in batches:
        step = max(1, ROWS_PER_CALL // size)
        for first in range(0, batch.num_rows, step):
            yield _Laid(batch.slice(first, step), size)


def series_recursions(bars: DataFrame, keys: Sequence[str], block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """Recursive indicators of every bar of whole series, unlike those of a look-back window.

    Adds ema_fast, ema_slow, macd, macd_signal, macd_hist, rsi, plus_di, minus_di and adx, null until they have
    their first mean. ``bars``: keys, idx from 0, high, low, close; other columns ride along. A block of bars is one
    stored row; only those rows travel, once for the states of either scan, and all values are made anew from the prices.
    """
    keys = list(keys)
    kept = [c for c in bars.columns if c not in (*_RESULTS, *keys, "block", "core")]
    rows = halo_blocks(bars.select(*keys, *kept), before=1, size=block).groupBy(*keys, "block")
    blocks = stored_once(rows.agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in kept if c != "idx"]))).alias("_rows")), "recurrence-blocks")
    place = [*[blocks.schema[c] for c in (*keys, "block")]]
    doubles = ArrayType(DoubleType())
    map_schema = StructType([*place, StructField("a", doubles), StructField("b", doubles)])
    map_arrow = to_arrow_schema(map_schema)

    def maps(how) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for laid in _laid(batches, block):
                ends = [x[laid.ends].tolist() for x in how(laid)]
                yield pa.RecordBatch.from_arrays([*[laid.batch.column(c).cast(map_arrow.field(c).type) for c in (*keys, "block")], *[pa.array(x, f.type) for x, f in zip(ends, list(map_arrow)[-2:])]], schema=map_arrow)

        return run

    own = [*keys, "block"]
    first = states_before(stored_once(blocks.mapInArrow(maps(lambda laid: laid.first()), map_schema), "recurrence-maps"), keys, len(_FIRST), fanout)
    first = stored_once(first.withColumnRenamed("state", "_state"), "recurrence-states")
    second = blocks.join(first, own).mapInArrow(maps(lambda laid: laid.second(laid.levels())), map_schema)
    second = states_before(stored_once(second, "recurrence-maps"), keys, len(_SECOND), fanout)
    schema = StructType([*[bars.schema[c] for c in (*keys, *kept)], *[StructField(c, DoubleType()) for c in _RESULTS]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for laid in _laid(batches, block):
            core, at = pa.array(laid.core), pa.array(laid.stretch)
            columns = {c: laid.batch.column(c).take(at) for c in keys} | laid.rows | laid.results()
            yield pa.RecordBatch.from_arrays([columns[f.name].filter(core).cast(f.type) for f in arrow], schema=arrow)

    states = first.join(second.withColumnRenamed("state", "_state2"), own)
    made = blocks.join(states, own).mapInArrow(run, schema)
    return made.select(*[c for c in bars.columns if c in schema.names and c not in _RESULTS], *_RESULTS)
