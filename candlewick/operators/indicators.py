"""Indicators over blocks of numbered bars.

Bounded-frame indicators of a whole series are native window expressions where frames
are short; averages and bands of all bars of many blocks are added up at once in numpy.
Recursive ones (EMA, Wilder smoothing) restart at the beginning of every
look-back window, so a walk steps all windows of many blocks at once in numpy
(``walk_snapshots``). The last-bar form is a fold over a bounded array
(``fold_*``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewick.functions.numbers import is_true, rounded, rounded_array
from candlewick.operators.series import block_window, dealt, halo_blocks

# Indicator periods and thresholds.
SMA_PERIODS = (10, 20, 50, 100, 200)
BAND_PERIOD = 20
ADX_PERIOD = 14
ADX_SLOPE_BARS = 5
RSI_PERIOD = 14
STOCH_PERIOD = 14
STOCH_SMOOTH = 3
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
EXTREME_BARS = 10
MIN_BARS = 30
FLAT_BAND = 1e-12

FRAME_COLUMNS = (
    *[f"sma_{p}" for p in SMA_PERIODS],
    "bb_mid", "bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2", "high_n", "low_n", "stoch_k", "stoch_d",
)
AVERAGE_COLUMNS = (*[f"sma_{p}" for p in SMA_PERIODS], "bb_mid", "bb_upper_2", "bb_upper_1", "bb_lower_1", "bb_lower_2")
SHORT_COLUMNS = ("tr", "plus_dm", "minus_dm", "high_n", "low_n", "stoch_k", "stoch_d")
ROWS_PER_CALL = 65_536
EDGES_PER_STEP = 16_384

#: Digits to which a snapshot's values are rounded.
SNAPSHOT_DIGITS = {
    **{c: 6 for c in (*AVERAGE_COLUMNS, "macd", "macd_signal", "macd_hist", "high_n", "low_n")},
    **{c: 4 for c in ("adx", "plus_di", "minus_di", "rsi", "stoch_k", "stoch_d", "adx_slope")},
}
RECURSIVE_COLUMNS = ("macd", "macd_signal", "macd_hist", "rsi", "adx", "plus_di", "minus_di", "adx_slope")


# Bounded frames -------------------------------------------------------------


def full_frame(w, period: int, x: Column, value: Column) -> Column:
    """``value`` where the last ``period`` rows all hold a non-null ``x``."""
    return F.when(F.count(x).over(w.rowsBetween(-(period - 1), 0)) == period, value)


def sma_of_optional(x: Column, period: int, w) -> Column:
    """Moving average of a column with nulls; null until ``period`` values in a row."""
    return full_frame(w, period, x, F.avg(x).over(w.rowsBetween(-(period - 1), 0)))


def sma(x: Column, period: int, w) -> Column:
    """Moving average of a column without nulls; null until bar ``period - 1``."""
    return F.when(F.col("idx") >= period - 1, F.avg(x).over(w.rowsBetween(-(period - 1), 0)))


def rolling_stdev(x: Column, period: int, w) -> Column:
    """Population standard deviation of the last ``period`` values."""
    return F.when(F.col("idx") >= period - 1, F.stddev_pop(x).over(w.rowsBetween(-(period - 1), 0)))


def extremes(n: int, w) -> tuple[Column, Column]:
    """Highest high and lowest low of the last ``n`` bars (fewer at the start)."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.max("high").over(frame), F.min("low").over(frame)


def true_range(w) -> Column:
    """Range against the previous close; null on the first bar."""
    prev = F.lag("close").over(w)
    return F.when(
        prev.isNotNull(),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def directional_moves(w) -> tuple[Column, Column]:
    """+DM and −DM; null on the first bar."""
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    plus = F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)))
    minus = F.when(down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))
    return plus, minus


def raw_stochastic(w) -> Column:
    """Unsmoothed %K; 50 on a flat range."""
    frame = w.rowsBetween(-(STOCH_PERIOD - 1), 0)
    top, bottom = F.max("high").over(frame), F.min("low").over(frame)
    value = F.when(top == bottom, F.lit(50.0)).otherwise(F.lit(100.0) * (F.col("close") - bottom) / (top - bottom))
    return F.when(F.col("idx") >= STOCH_PERIOD - 1, value)


def average_range(w, period: int = 14) -> Column:
    """Mean of the last min(period, n−1) true ranges; high − low on a lone bar.

    Needs a ``tr`` column from ``true_range``.
    """
    return F.coalesce(F.avg("tr").over(w.rowsBetween(-(period - 1), 0)), F.abs(F.col("high") - F.col("low")))


def band_columns(w, period: int = BAND_PERIOD) -> dict[str, Column]:
    """Double Bollinger bands as ``bb_mid``, ``bb_upper_1`` and so on."""
    mid, sd = sma(F.col("close"), period, w), rolling_stdev(F.col("close"), period, w)
    return {
        "bb_mid": mid,
        "bb_upper_2": mid + 2.0 * sd,
        "bb_upper_1": mid + 1.0 * sd,
        "bb_lower_1": mid - 1.0 * sd,
        "bb_lower_2": mid - 2.0 * sd,
    }


def band_zone(close: Column, upper_2: Column, upper_1: Column, lower_1: Column, lower_2: Column) -> Column:
    """trend_up / trend_down beyond one sigma, range within, unknown without bands."""
    missing = upper_2.isNull() | upper_1.isNull() | lower_1.isNull() | lower_2.isNull()
    return (
        F.when(missing, "unknown")
        .when(upper_1 - lower_1 <= FLAT_BAND, "range")
        .when(close > upper_1, "trend_up")
        .when(close < lower_1, "trend_down")
        .otherwise("range")
    )


def stack_order(averages: Sequence[Column]) -> Column:
    """up / down when the averages, shortest first, are strictly stacked; else null."""
    pairs = list(zip(averages, averages[1:]))
    falling, rising = F.lit(True), F.lit(True)
    for a, b in pairs:
        falling, rising = falling & (a > b), rising & (a < b)
    return F.when(is_true(falling), "up").when(is_true(rising), "down")


def close_against(close: Column, level: Column) -> Column:
    return F.when(close > level, "above").when(close < level, "below").when(close == level, "at")


# Recursive indicators, all windows of a block at once ------------------------


def window_recursions(
    close: np.ndarray, tr: np.ndarray, plus: np.ndarray, minus: np.ndarray, edges: np.ndarray, length: int
) -> dict[str, np.ndarray]:
    """Recursive indicators of the windows of ``length`` bars that end at ``edges``.

    Position m of all windows is one gathered vector, so one step of a recursion
    is a few vector operations however many series the arrays hold. Position 0 of
    a window has no previous bar: its true range and moves are never read.
    """
    first = edges - (length - 1)
    price = lambda m: close[first + m]
    count = len(edges)
    out = {name: np.full(count, np.nan) for name in RECURSIVE_COLUMNS}

    def percent(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return 100.0 * np.divide(part, whole, out=np.zeros(count), where=whole != 0)

    def mean_at(values: np.ndarray, start: int, stop: int) -> np.ndarray:
        return sum(values[first + m] for m in range(start, stop)) / (stop - start)

    k_fast, k_slow, k_signal = (2.0 / (p + 1) for p in (MACD_FAST, MACD_SLOW, MACD_SIGNAL))
    fast, slow = mean_at(close, 0, MACD_FAST), mean_at(close, 0, MACD_SLOW)
    for m in range(MACD_FAST, MACD_SLOW):
        fast = price(m) * k_fast + fast * (1.0 - k_fast)
    line, seed, signal = fast - slow, [fast - slow], None
    for m in range(MACD_SLOW, length):
        now = price(m)
        fast = now * k_fast + fast * (1.0 - k_fast)
        slow = now * k_slow + slow * (1.0 - k_slow)
        line = fast - slow
        if signal is not None:
            signal = line * k_signal + signal * (1.0 - k_signal)
        else:
            seed.append(line)
            if len(seed) == MACD_SIGNAL:
                signal = sum(seed) / MACD_SIGNAL
    out["macd"] = line
    if signal is not None:
        out["macd_signal"], out["macd_hist"] = signal, line - signal

    change = np.diff(close, prepend=close[:1])
    gains, losses = np.maximum(change, 0.0), np.maximum(-change, 0.0)
    gain, loss = mean_at(gains, 1, RSI_PERIOD + 1), mean_at(losses, 1, RSI_PERIOD + 1)
    for m in range(RSI_PERIOD + 1, length):
        gain = (gain * (RSI_PERIOD - 1) + gains[first + m]) / RSI_PERIOD
        loss = (loss * (RSI_PERIOD - 1) + losses[first + m]) / RSI_PERIOD
    strength = np.divide(gain, loss, out=np.zeros(count), where=loss != 0)
    rsi = 100.0 - 100.0 / (1.0 + strength)
    out["rsi"] = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), np.where(gain == 0, 0.0, rsi))

    n = ADX_PERIOD
    s_range, s_up, s_down = (mean_at(a, 1, n + 1) for a in (tr, plus, minus))
    adx, adx_then, spread_sum = None, None, np.zeros(count)
    for m in range(n, length):
        if m > n:
            at = first + m
            s_range = (s_range * (n - 1) + tr[at]) / n
            s_up = (s_up * (n - 1) + plus[at]) / n
            s_down = (s_down * (n - 1) + minus[at]) / n
        plus_di, minus_di = percent(s_up, s_range), percent(s_down, s_range)
        spread = percent(np.abs(plus_di - minus_di), plus_di + minus_di)
        if adx is not None:
            adx = (adx * (n - 1) + spread) / n
        else:
            spread_sum = spread_sum + spread
            if m == 2 * n - 1:
                adx = spread_sum / n
        if m == length - 1 - ADX_SLOPE_BARS:
            adx_then = adx
    out["plus_di"], out["minus_di"] = plus_di, minus_di
    if adx is not None:
        out["adx"] = adx
        if adx_then is not None:
            out["adx_slope"] = adx - adx_then
    return out


def edge_snapshots(high: np.ndarray, low: np.ndarray, close: np.ndarray, edges: np.ndarray, lookback: int) -> dict[str, np.ndarray]:
    """Raw indicators at ``edges``, positions with ``lookback`` bars of their series behind them.

    The arrays may hold several series end to end: what mixes two of them lies
    before the first edge of the second and is not looked at.
    """
    view = np.lib.stride_tricks.sliding_window_view

    def trailing(values: np.ndarray, period: int, how) -> np.ndarray:
        out = np.full(len(values), np.nan)
        out[period - 1 :] = how(view(values, period), axis=1)
        return out

    previous = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - previous), np.abs(low - previous)))
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    # Windows are stepped in groups whose vectors stay in a core's cache.
    parts = [window_recursions(close, tr, plus, minus, edges[i : i + EDGES_PER_STEP], lookback) for i in range(0, max(len(edges), 1), EDGES_PER_STEP)]
    out = {c: np.concatenate([part[c] for part in parts]) for c in parts[0]}
    for p in SMA_PERIODS:
        out[f"sma_{p}"] = trailing(close, p, np.mean)[edges] if p <= lookback else np.full(len(edges), np.nan)
    mid, sd = (trailing(close, BAND_PERIOD, f)[edges] for f in (np.mean, np.std))
    out |= {"bb_mid": mid, "bb_upper_2": mid + 2 * sd, "bb_upper_1": mid + sd, "bb_lower_1": mid - sd, "bb_lower_2": mid - 2 * sd}
    out["high_n"], out["low_n"] = trailing(high, EXTREME_BARS, np.max)[edges], trailing(low, EXTREME_BARS, np.min)[edges]
    top, bottom = trailing(high, STOCH_PERIOD, np.max), trailing(low, STOCH_PERIOD, np.min)
    width = top - bottom
    raw = np.where(width == 0, 50.0, 100.0 * np.divide(close - bottom, width, out=np.zeros(len(close)), where=width != 0))
    k = trailing(raw, STOCH_SMOOTH, np.mean)
    out["stoch_k"], out["stoch_d"] = k[edges], trailing(k, STOCH_SMOOTH, np.mean)[edges]
    return out


def _label_rows(table: pa.Table, lookback: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Core rows of whole blocks, laid end to end, that have a full window, with rounded indicators."""
    edges = block_edges(table, lookback)
    if len(edges) == 0:
        return
    arrays = [table[c].to_numpy().astype(float) for c in ("high", "low", "close")]
    values = edge_snapshots(*arrays, edges, lookback)
    rising = values["adx_slope"] > 0
    values = {c: rounded_array(v, SNAPSHOT_DIGITS[c]) for c, v in values.items()} | {"adx_rising": rising}
    kept = table.take(pa.array(edges))
    columns = [
        pa.array(values[f.name], type=f.type, from_pandas=True) if f.name in values else kept[f.name].cast(f.type) for f in schema
    ]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=ROWS_PER_CALL)


def _split_at_last_block(table: pa.Table) -> int:
    """Where the last, maybe unfinished, block of a stretch of rows begins."""
    idx, block = table["idx"].to_numpy(), table["block"].to_numpy()
    return int(np.flatnonzero(np.concatenate([[True], (np.diff(idx) != 1) | (np.diff(block) != 0)]))[-1])


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a partition sorted by (keys, block, idx) as tables of about ``ROWS_PER_CALL`` rows that end between blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS_PER_CALL:
            table = pa.Table.from_batches(held)
            cut = _split_at_last_block(table)
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def block_edges(table: pa.Table, lookback: int) -> np.ndarray:
    """Places of core rows of whole blocks, laid end to end, that have ``lookback`` rows up to and including them."""
    return np.flatnonzero((block_places(table) >= lookback - 1) & table["core"].to_numpy())


def block_places(table: pa.Table) -> np.ndarray:
    """How many rows of its block lie before each row of whole blocks, laid end to end."""
    idx, block = table["idx"].to_numpy(), table["block"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(idx) != 1) | (np.diff(block) != 0)]))
    return np.arange(len(idx)) - np.repeat(starts, np.diff(np.append(starts, len(idx))))


def frame_averages(close: np.ndarray, present: np.ndarray, place: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Moving averages and bands of bars laid end to end, each with where it is missing.

    A frame is added up from its oldest bar to its newest, and deviations by Welford's update, as an
    aggregate over that frame does it, so results are the same to the last bit. ``place`` counts the bars
    of a block before each; absent closes take no part.
    """
    count, value, there = len(close), np.where(present, close, 0.0), present.astype(float)
    whole = bool(present.all())

    def frame(period: int, n: np.ndarray, spread: bool = False) -> np.ndarray:
        size = max(count - period + 1, 0)
        out = np.full(count, np.nan)
        total, seen, mean, square = (np.zeros(size) for _ in range(4))
        for m in range(min(period, count) if size else 0):
            x = value[m : m + size]
            if not spread:
                total += x
                continue
            seen += there[m : m + size]
            delta = x - mean if whole else np.where(present[m : m + size], x - mean, 0.0)
            step = delta / (m + 1.0 if whole else np.maximum(seen, 1.0))
            mean += step
            square += delta * (delta - step)
        if size:
            out[period - 1 :] = np.sqrt(square / n[period - 1 :]) if spread else total / n[period - 1 :]
        return out

    def members(period: int) -> np.ndarray:
        if whole:
            return np.full(count, float(period))
        ends = np.concatenate([[0.0], np.cumsum(there)])
        return ends[1:] - ends[np.maximum(np.arange(count) + 1 - period, 0)]

    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for p in SMA_PERIODS:
            n = members(p)
            out[f"sma_{p}"] = (frame(p, n), (place < p - 1) | (n == 0))
        n = members(BAND_PERIOD)
        none = (place < BAND_PERIOD - 1) | (n == 0)
        mid = out[f"sma_{BAND_PERIOD}"][0] if BAND_PERIOD in SMA_PERIODS else frame(BAND_PERIOD, n)
        sd = frame(BAND_PERIOD, n, spread=True)
        bands = {"bb_mid": mid, "bb_upper_2": mid + 2.0 * sd, "bb_upper_1": mid + 1.0 * sd, "bb_lower_1": mid - 1.0 * sd, "bb_lower_2": mid - 2.0 * sd}
    return out | {name: (values, none) for name, values in bands.items()}


def _with_averages(laid: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows sorted by (keys, block, idx) with ``names`` of the averages and bands; null outside core rows."""
    kept = [f for f in laid.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(c, T.DoubleType()) for c in names])
    arrow_schema = to_arrow_schema(schema)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            close, core = table["close"].cast(pa.float64()), table["core"].to_numpy()
            values = frame_averages(close.fill_null(0.0).to_numpy(), close.is_valid().to_numpy(), block_places(table))
            columns = [
                pa.array(values[f.name][0], mask=values[f.name][1] | ~core) if f.name in values else table[f.name].cast(f.type)
                for f in arrow_schema
            ]
            yield from pa.Table.from_arrays(columns, schema=arrow_schema).to_batches(max_chunksize=ROWS_PER_CALL)

    return laid.select(*[f.name for f in kept]).mapInArrow(average, schema)


def indicator_blocks(
    bars: DataFrame, keys: Sequence[str], before: int = max(SMA_PERIODS) - 1, columns: Sequence[str] | None = None
) -> DataFrame:
    """Halo blocks with bounded-frame indicators (``columns`` of them, else every one), unrounded; exact on core rows.

    Short frames are window expressions, which go over the whole frame for each bar. Averages and bands, whose frames
    are long, are added up for all bars of many blocks at once, and come on core rows only.
    """
    names = [*AVERAGE_COLUMNS, *SHORT_COLUMNS] if columns is None else [c for c in columns if c in (*AVERAGE_COLUMNS, *SHORT_COLUMNS)]
    laid = dealt(halo_blocks(bars, before=before), *keys, "block").sortWithinPartitions(*keys, "block", "idx")
    if any(c in SHORT_COLUMNS for c in names):
        w = block_window(keys)
        plus, minus = directional_moves(w)
        high_n, low_n = extremes(EXTREME_BARS, w)
        first = laid.withColumns(
            {"tr": true_range(w), "plus_dm": plus, "minus_dm": minus, "_raw_k": raw_stochastic(w), "high_n": high_n, "low_n": low_n}
        )
        second = first.withColumn("stoch_k", sma_of_optional(F.col("_raw_k"), STOCH_SMOOTH, w))
        third = second.withColumn("stoch_d", sma_of_optional(F.col("stoch_k"), STOCH_SMOOTH, w))
        laid = third.drop("_raw_k", *[c for c in SHORT_COLUMNS if c not in names])
    averages = [c for c in names if c in AVERAGE_COLUMNS]
    return _with_averages(laid, averages) if averages else laid


def rounded_snapshot(df: DataFrame) -> DataFrame:
    """Round raw indicators and derive zone, width, order and close-versus-average.

    Derived fields read the rounded levels; ``adx_rising`` reads the raw slope.
    """
    out = df.withColumn("adx_rising", is_true(F.col("adx_slope") > 0))
    return derived_snapshot(out.withColumns({c: rounded(F.col(c), digits) for c, digits in SNAPSHOT_DIGITS.items()}))


def derived_snapshot(df: DataFrame) -> DataFrame:
    """Zone, width, order and close-versus-average of rounded indicators."""
    out = df.withColumn("last_close", rounded(F.col("close"), 6))
    mid, u2, l2 = F.col("bb_mid"), F.col("bb_upper_2"), F.col("bb_lower_2")
    missing = [F.when(F.col(f"sma_{p}").isNull(), F.lit(p)) for p in SMA_PERIODS]
    return out.withColumns(
        {
            "bb_width": F.when((mid != 0) & u2.isNotNull() & l2.isNotNull(), rounded((u2 - l2) / mid, 6)),
            "bb_zone": band_zone(F.col("close"), u2, F.col("bb_upper_1"), F.col("bb_lower_1"), l2),
            "ma_perfect_order": stack_order([F.col(f"sma_{p}") for p in SMA_PERIODS]),
            "sma_missing": F.array_compact(F.array(*missing)),
            **{f"vs_sma_{p}": close_against(F.col("close"), F.col(f"sma_{p}")) for p in SMA_PERIODS},
        }
    )


def walk_snapshots(bars: DataFrame, keys: Sequence[str], lookback: int = 250) -> DataFrame:
    """The rounded snapshot of every bar that has ``lookback`` bars up to and including it.

    One shuffle by (keys, block) and one sort; tasks then label as many whole
    blocks per call as fit ``ROWS_PER_CALL``, so short series share vectors and
    long ones are spread by block. Values are rounded there too.
    """
    if lookback < MIN_BARS:
        raise ValueError(f"lookback must be >= {MIN_BARS}; got {lookback}")
    names = [*FRAME_COLUMNS, *RECURSIVE_COLUMNS]
    passed = [f for f in bars.schema.fields if f.name not in (*names, "adx_rising")]
    made = [T.StructField(c, T.DoubleType()) for c in names] + [T.StructField("adx_rising", T.BooleanType())]
    schema = T.StructType(passed + made)
    arrow_schema = to_arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            yield from _label_rows(table, lookback, arrow_schema)

    blocks = halo_blocks(bars.select(*[f.name for f in passed]), before=lookback - 1)
    laid = dealt(blocks, *keys, "block").sortWithinPartitions(*keys, "block", "idx")
    return derived_snapshot(laid.mapInArrow(label, schema))


# Last-bar folds over one bounded array ---------------------------------------


def _let(value: Column, body) -> Column:
    """Bind an expression once inside a lambda."""
    return F.transform(F.array(value), body)[0]


def fold_macd(values: Column) -> Column:
    """Struct (macd, macd_signal, macd_hist) of the last value of an array."""
    k_fast, k_slow, k_signal = (2.0 / (p + 1) for p in (MACD_FAST, MACD_SLOW, MACD_SIGNAL))

    def mean_of(n: int) -> Column:
        return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n

    fast_at_slow = F.aggregate(
        F.slice(values, MACD_FAST + 1, MACD_SLOW - MACD_FAST),
        mean_of(MACD_FAST),
        lambda ema, x: x * k_fast + ema * (1.0 - k_fast),
    )
    start = _let(
        F.struct(fast_at_slow.alias("fast"), mean_of(MACD_SLOW).alias("slow")),
        lambda s: F.struct(
            s["fast"].alias("fast"),
            s["slow"].alias("slow"),
            F.lit(1).alias("seen"),
            (s["fast"] - s["slow"]).alias("total"),
            F.lit(None).cast("double").alias("signal"),
        ),
    )

    def step(s: Column, x: Column) -> Column:
        moved = F.struct((x * k_fast + s["fast"] * (1.0 - k_fast)).alias("f"), (x * k_slow + s["slow"] * (1.0 - k_slow)).alias("s"))

        def merge(m: Column) -> Column:
            line = m["f"] - m["s"]
            seen = s["seen"] + 1
            total = s["total"] + line
            signal = (
                F.when(seen < MACD_SIGNAL, F.lit(None).cast("double"))
                .when(seen == MACD_SIGNAL, total / MACD_SIGNAL)
                .otherwise(line * k_signal + s["signal"] * (1.0 - k_signal))
            )
            return F.struct(
                m["f"].alias("fast"), m["s"].alias("slow"), seen.alias("seen"), total.alias("total"), signal.alias("signal")
            )

        return _let(moved, merge)

    rest = F.slice(values, MACD_SLOW + 1, F.greatest(F.size(values) - MACD_SLOW, F.lit(0)))

    def finish(s: Column) -> Column:
        line = s["fast"] - s["slow"]
        return F.struct(line.alias("macd"), s["signal"].alias("macd_signal"), (line - s["signal"]).alias("macd_hist"))

    return F.when(F.size(values) >= MACD_SLOW, F.aggregate(rest, start, step, finish))


def fold_rsi(values: Column) -> Column:
    """Last Wilder RSI of an array of closes."""
    n = RSI_PERIOD
    steps = F.greatest(F.size(values) - 1, F.lit(0))
    changes = F.zip_with(F.slice(values, 2, steps), F.slice(values, 1, steps), lambda x, prev: x - prev)

    def part(sign: float) -> Column:
        return F.aggregate(F.slice(changes, 1, n), F.lit(0.0), lambda a, c: a + F.greatest(c * sign, F.lit(0.0))) / n

    start = F.struct(part(1.0).alias("gain"), part(-1.0).alias("loss"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(
            ((s["gain"] * (n - 1) + F.greatest(c, F.lit(0.0))) / n).alias("gain"),
            ((s["loss"] * (n - 1) + F.greatest(-c, F.lit(0.0))) / n).alias("loss"),
        )

    def finish(s: Column) -> Column:
        return (
            F.when(s["loss"] == 0, F.when(s["gain"] > 0, 100.0).otherwise(50.0))
            .when(s["gain"] == 0, 0.0)
            .otherwise(100.0 - 100.0 / (1.0 + s["gain"] / s["loss"]))
        )

    rest = F.slice(changes, n + 1, F.greatest(F.size(changes) - n, F.lit(0)))
    return F.when(F.size(values) > n, F.aggregate(rest, start, step, finish))


def fold_adx(moves: Column) -> Column:
    """Struct (adx, plus_di, minus_di, adx_slope) of the last bar.

    ``moves`` is an array of structs (tr, plus_dm, minus_dm), one per bar in
    order, whose first entry is ignored.
    """
    n = ADX_PERIOD
    null = F.lit(None).cast("double")
    size = F.size(moves)

    def mean_of(field: str) -> Column:
        return F.aggregate(F.slice(moves, 2, n), F.lit(0.0), lambda a, x: a + x[field]) / n

    def percent(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)

    def lines(tr: Column, up: Column, down: Column) -> Column:
        return F.struct(
            tr.alias("tr"), up.alias("up"), down.alias("down"), percent(up, tr).alias("pdi"), percent(down, tr).alias("mdi")
        )

    def spread(v: Column) -> Column:
        return percent(F.abs(v["pdi"] - v["mdi"]), v["pdi"] + v["mdi"])

    def state(v: Column, seen: Column, total: Column, adx: Column, then: Column) -> Column:
        return F.struct(
            *[v[f].alias(f) for f in ("tr", "up", "down", "pdi", "mdi")],
            seen.alias("seen"), total.alias("total"), adx.alias("adx"), then.alias("then"),
        )

    start = _let(
        lines(mean_of("tr"), mean_of("plus_dm"), mean_of("minus_dm")),
        lambda v: state(v, F.lit(1), spread(v), null, null),
    )

    def step(s: Column, x: Column) -> Column:
        moved = lines(
            (s["tr"] * (n - 1) + x["tr"]) / n, (s["up"] * (n - 1) + x["plus_dm"]) / n, (s["down"] * (n - 1) + x["minus_dm"]) / n
        )

        def merge(v: Column) -> Column:
            seen = s["seen"] + 1
            total = F.when(seen <= n, s["total"] + spread(v)).otherwise(s["total"])
            adx = (
                F.when(seen < n, null)
                .when(seen == n, (s["total"] + spread(v)) / n)
                .otherwise((s["adx"] * (n - 1) + spread(v)) / n)
            )
            then = F.when(seen + n == size - ADX_SLOPE_BARS, adx).otherwise(s["then"])
            return state(v, seen, total, adx, then)

        return _let(moved, merge)

    def finish(s: Column) -> Column:
        return F.struct(
            s["adx"].alias("adx"), s["pdi"].alias("plus_di"), s["mdi"].alias("minus_di"), (s["adx"] - s["then"]).alias("adx_slope")
        )

    rest = F.slice(moves, n + 2, F.greatest(size - n - 1, F.lit(0)))
    return F.when(size > n, F.aggregate(rest, start, step, finish))


def last_snapshots(bars: DataFrame, keys: Sequence[str], count: int = 250) -> tuple[DataFrame, DataFrame]:
    """Snapshot of each series' last bar over its last ``count`` bars, and the rejects.

    A series with fewer than 30 bars, or with an invalid bar, is rejected with a
    reason. Only ``count`` bars per series reach the grouping step.
    """
    recent = Window.partitionBy(*keys).orderBy(F.col("idx").desc())
    last = bars.withColumn("_r", F.row_number().over(recent)).filter(F.col("_r") <= count)
    first = F.min("idx").over(Window.partitionBy(*keys))
    last = last.drop("_r").withColumn("_idx", F.col("idx")).withColumn("idx", F.col("idx") - first)
    w = Window.partitionBy(*keys).orderBy("idx")
    plus, minus = directional_moves(w)
    rows = last.withColumns({"tr": true_range(w), "plus_dm": plus, "minus_dm": minus, "_raw_k": raw_stochastic(w)})
    rows = rows.withColumn("_k", sma_of_optional(F.col("_raw_k"), STOCH_SMOOTH, w)).withColumn("_d", sma_of_optional(F.col("_k"), STOCH_SMOOTH, w))
    fields = ["idx", "_idx", "ts", "open", "high", "low", "close", "tr", "plus_dm", "minus_dm", "_k", "_d"]
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_bars"),
        F.count("*").alias("bar_count"),
        F.bool_or(is_true(F.col("high") < F.col("low"))).alias("_bad"),
        F.bool_or(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()).alias("_gap"),
    )
    reason = (
        F.when(F.col("_gap"), "missing price")
        .when(F.col("_bad"), "high < low")
        .when(F.col("bar_count") < MIN_BARS, F.concat(F.lit(f"need at least {MIN_BARS} bars; got "), F.col("bar_count").cast("string")))
    )
    grouped = grouped.withColumn("reason", reason)
    rejects = grouped.filter(F.col("reason").isNotNull()).select(*keys, "bar_count", "reason")
    good = grouped.filter(F.col("reason").isNull()).drop("reason", "_bad", "_gap")
    closes = F.col("_bars")["close"]
    total = F.size("_bars")

    def tail(field: str, n: int) -> Column:
        return F.slice(F.col("_bars")[field], F.greatest(total - n + 1, F.lit(1)), n)

    def mean(a: Column, n: int) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n

    def tail_mean(n: int) -> Column:
        return F.when(total >= n, mean(tail("close", n), n))

    band_mean = tail_mean(BAND_PERIOD)
    deviation = F.sqrt(
        F.aggregate(tail("close", BAND_PERIOD), F.lit(0.0), lambda s, x: s + (x - F.col("_mid")) * (x - F.col("_mid"))) / BAND_PERIOD
    )
    end = F.element_at("_bars", -1)
    flat = (
        good.withColumns({"_mid": band_mean, "_macd": fold_macd(closes), "_adx": fold_adx(F.col("_bars")), "rsi": fold_rsi(closes)})
        .withColumn("_sd", F.when(total >= BAND_PERIOD, deviation))
        .select(
            *keys,
            "bar_count",
            end["_idx"].alias("idx"),
            *[end[c].alias(c) for c in ("ts", "open", "high", "low", "close")],
            *[tail_mean(p).alias(f"sma_{p}") for p in SMA_PERIODS],
            F.col("_mid").alias("bb_mid"),
            (F.col("_mid") + 2.0 * F.col("_sd")).alias("bb_upper_2"),
            (F.col("_mid") + F.col("_sd")).alias("bb_upper_1"),
            (F.col("_mid") - F.col("_sd")).alias("bb_lower_1"),
            (F.col("_mid") - 2.0 * F.col("_sd")).alias("bb_lower_2"),
            F.array_max(tail("high", EXTREME_BARS)).alias("high_n"),
            F.array_min(tail("low", EXTREME_BARS)).alias("low_n"),
            end["_k"].alias("stoch_k"),
            end["_d"].alias("stoch_d"),
            "rsi",
            *[F.col("_macd")[c].alias(c) for c in ("macd", "macd_signal", "macd_hist")],
            *[F.col("_adx")[c].alias(c) for c in ("adx", "plus_di", "minus_di", "adx_slope")],
        )
    )
    return rounded_snapshot(flat), rejects


def plot_series(bars: DataFrame, keys: Sequence[str], counts: DataFrame, lookback: int = 80) -> DataFrame:
    """Averages and bands of the last ``lookback`` bars of each series, unrounded.

    ``counts`` holds (keys, bar_count); frames reach back into earlier bars.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    span = max(SMA_PERIODS) - 1 + lookback
    recent = bars.join(counts.select(*keys, "bar_count"), list(keys)).filter(F.col("idx") >= F.col("bar_count") - span)
    out = recent.withColumns({**{f"sma_{p}": sma(F.col("close"), p, w) for p in SMA_PERIODS}, **band_columns(w)})
    return out.filter(F.col("idx") >= F.col("bar_count") - lookback)
