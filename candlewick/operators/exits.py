"""First-touch exits without a horizon.

A position searches the rest of its own block of bars; what stays open climbs to the
lows and highs of whole blocks, and so on up, and comes back down to the first touched bar.
Each search is one grouped pass over a block of bounded size: bars travel once, and
candidates only carry their own row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from candlewick.operators.series import dealt
from candlewick.session import stored_once

#: Bars of a block, and blocks of a block one level up.
SIZE = 2048
#: Entries that search a block together; many spans read their own copy of a block they all reach.
SPAN = 64 * SIZE


def first_touch(low: np.ndarray, high: np.ndarray, start: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """First place at or after ``start`` with low <= floor or high >= ceiling; len(low) where there is none.

    Lows and highs of 1, 2, 4, ... places are made once; all searches then step together,
    over the widest stretch that does not touch.
    """
    lows, highs = [low], [high]
    while 2 << (len(lows) - 1) <= len(low):
        half = 1 << (len(lows) - 1)
        lows.append(np.fmin(lows[-1][:-half], lows[-1][half:]))
        highs.append(np.fmax(highs[-1][:-half], highs[-1][half:]))
    at = start.copy()
    for k in range(len(lows) - 1, -1, -1):
        # A stretch of each size is stepped over once at most, but the widest may repeat.
        while True:
            open_ = np.flatnonzero(at + (1 << k) <= len(low))
            clear = open_[~((lows[k][at[open_]] <= floor[open_]) | (highs[k][at[open_]] >= ceiling[open_]))]
            at[clear] += 1 << k
            if k < len(lows) - 1 or not len(clear):
                break
    return at


def _scan(cands: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the first touched item of their ``_block`` after ``_at`` (null where none is)."""
    place = [*keys, "_block", "_span"]
    bars = {"_hit": "_item", "_hit_ts": "_ts", "_hit_low": "_low", "_hit_high": "_high"}
    names = [*cands.columns, *bars]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        item, hit = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows:
            right = right.sort_by("_item")
            item = right["_item"].to_numpy()
            low, high = (right[c].to_numpy().astype(float) for c in ("_low", "_high"))
            start = np.searchsorted(item, left["_at"].to_numpy(), "right")
            hit = first_touch(low, high, start, left["_floor"].to_numpy(), left["_ceiling"].to_numpy())
        found = pa.array(hit, mask=hit >= len(item))
        return pa.Table.from_arrays([*left.columns, *[right[c].take(found) for c in bars.values()]], names=names)

    items = items.select(*[F.col(c).alias(c) for c in items.columns])  # both sides may stem from one table
    out = StructType(cands.schema.fields + [StructField(n, items.schema[c].dataType) for n, c in bars.items()])
    return dealt(cands, *place).groupBy(*place).cogroup(dealt(items, *place).groupBy(*place)).applyInArrow(search, out)


def _levels(items: DataFrame) -> int:
    """Levels of blocks until one block holds every series."""
    largest, levels, width = items.agg(F.max("_item")).first()[0] or 0, 1, SIZE
    while width <= largest:
        levels, width = levels + 1, width * SIZE
    return levels


def _search(cands: DataFrame, items: DataFrame, keys: list[str], levels: int, bars: bool = False) -> DataFrame:
    """``bars``: items are bars and candidates begin at their own, so that its number tells the span; else blocks are joined to spans."""
    block = lambda c: F.floor(F.col(c) / SIZE)
    own = cands.withColumns({"_block": block("_at"), "_span": F.floor(F.col("_entry") / SPAN)})
    placed = items.withColumn("_block", block("_item"))
    if bars:
        reached = placed.withColumn("_span", F.floor(F.col("_item") / SPAN))
    else:
        reached = placed.join(own.select(*keys, "_block", "_span").distinct(), [*keys, "_block"])
    found = _scan(own, reached, keys)
    if levels == 1:
        return found.drop("_block", "_span")
    found = stored_once(found.drop("_block", "_span"), "touches")
    hits = [c for c in found.columns if c.startswith("_hit")]
    blocks = placed.groupBy(*keys, F.col("_block").alias("_item")).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_ts").alias("_ts"))
    origin = f"_from_{levels}"  # every level has its own
    waiting = found.filter("_hit is null").drop(*hits).withColumn(origin, F.col("_at")).withColumn("_at", block(origin))
    climbed = stored_once(_search(waiting, blocks, keys, levels - 1), "climbs")
    never = climbed.filter("_hit is null").withColumn("_at", F.col(origin)).drop(origin)
    reached = climbed.filter("_hit is not null").select(*[c for c in climbed.columns if c not in ("_at", origin, *hits)], (F.col("_hit") * SIZE - 1).alias("_at"), F.col("_hit").alias("_block"))
    reached = reached.withColumn("_span", F.floor(F.col("_entry") / SPAN))
    wanted = reached.select(*keys, "_block", "_span").distinct()
    lower = _scan(reached, placed.join(wanted, [*keys, "_block"]), keys).drop("_block", "_span")
    return found.filter("_hit is not null").unionByName(never).unionByName(lower)


def first_touches(cands: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_hit``, ``_hit_ts``, ``_hit_low`` and ``_hit_high``: the first bar after ``_entry`` that touches.

    ``cands``: keys, ``_entry``, ``_floor``, ``_ceiling`` and more; ``bars``: keys, idx, ts, low, high, read
    several times. A null bound never touches.
    """
    keys = list(keys)
    items = bars.select(*keys, F.col("idx").cast("long").alias("_item"), F.col("ts").alias("_ts"), F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high"))
    bounds = {
        "_floor": F.coalesce(F.col("_floor").cast("double"), F.lit(float("-inf"))), "_ceiling": F.coalesce(F.col("_ceiling").cast("double"), F.lit(float("inf"))),
        "_at": F.col("_entry").cast("long"),
    }
    return _search(cands.withColumns(bounds), items, keys, _levels(items), bars=True).drop("_at")
