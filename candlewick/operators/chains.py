"""One open position per series, chosen by composing block functions in a tree.

Which entries are taken depends on the whole past of a series, but a block of entries is
a step function: from the first index at which an entry is allowed to the first index after the
block at which the next one is. Functions of ``fanout`` blocks compose to that of a larger block,
level by level; then the arrival at each block comes down the same tree and
blocks select in parallel. A level keeps only the points at which a chain can arrive from outside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from candlewick.session import stored_once

#: Indexes of a block of entries, and blocks (then nodes) that one step composes.
BLOCK, FANOUT = 65_536, 64

_LONGS = ArrayType(LongType())


def _leave_points(entries: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """For each candidate of a block, the exit at which a chain started there leaves the block."""
    following = np.searchsorted(entries, exits, side="right")
    out = exits.copy()
    for i in range(len(entries) - 1, -1, -1):
        if following[i] < len(entries):
            out[i] = out[following[i]]
    return out


@F.pandas_udf(_LONGS)
def _block_outs(entries: pd.Series, exits: pd.Series) -> pd.Series:
    return pd.Series([_leave_points(np.asarray(e), np.asarray(x)) for e, x in zip(entries, exits)])


@F.pandas_udf(_LONGS)
def _block_steps(entries: pd.Series, outs: pd.Series, points: pd.Series, end: pd.Series) -> pd.Series:
    """For each first allowed index, that after the block: past the exit, at the block's end at least."""

    def steps(e, o, p, last):
        e, o, p = np.asarray(e), np.asarray(o), np.asarray(p)
        found = np.searchsorted(e, p, side="left")
        inside = found < len(e)
        after = np.full(len(p), last)
        after[inside] = np.maximum(o[found[inside]] + 1, last)
        return after

    return pd.Series([steps(*row) for row in zip(entries, outs, points, end)])


@F.pandas_udf(_LONGS)
def _block_chain(entries: pd.Series, exits: pd.Series, allowed: pd.Series) -> pd.Series:
    """Entries taken inside one block by a chain that may enter from ``allowed`` on."""

    def chain(e, x, first):
        e, x, taken = np.asarray(e), np.asarray(x), []
        i = int(np.searchsorted(e, first, side="left"))
        while i < len(e):
            taken.append(int(e[i]))
            i = int(np.searchsorted(e, x[i], side="right"))
        return taken

    return pd.Series([chain(*row) for row in zip(entries, exits, allowed)])


@F.pandas_udf(_LONGS)
def _composed(points: pd.Series, after: pd.Series, wanted: pd.Series) -> pd.Series:
    """The functions of a node's children composed, at the wanted points: where a chain leaves the node."""

    def compose(p, a, w):
        leads = dict(zip(np.asarray(p).tolist(), np.asarray(a).tolist()))
        for at in sorted(leads, reverse=True):  # a point leads to later ones, which are composed by then
            leads[at] = leads.get(leads[at], leads[at])
        return [leads[at] for at in np.asarray(w).tolist()]

    return pd.Series([compose(*row) for row in zip(points, after, wanted)])


@F.pandas_udf(_LONGS)
def _visited(points: pd.Series, after: pd.Series, arrival: pd.Series, end: pd.Series) -> pd.Series:
    """Points at which a chain that arrives at a node arrives at its children."""

    def visit(p, a, at, last):
        leads, seen = dict(zip(np.asarray(p).tolist(), np.asarray(a).tolist())), []
        while at < last:
            seen.append(at)
            at = leads[at]
        return seen

    return pd.Series([visit(*row) for row in zip(points, after, arrival, end)])


def _points(moves: DataFrame, keys: list[str], width: int, last: DataFrame) -> DataFrame:
    """(keys, node, points): the start of every node, and where chains come in from other nodes."""
    node = lambda c: F.floor(F.col(c) / width)
    arrivals = moves.filter(node("point") != node("after")).join(last, keys).filter(F.col("after") <= F.col("last")).select(*keys, F.col("after").alias("point"))
    starts = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / width))).alias("n")).select(*keys, (F.col("n") * width).alias("point"))
    return arrivals.unionByName(starts).groupBy(*keys, node("point").alias("node")).agg(F.array_sort(F.collect_set("point")).alias("points"))


def select_sequential(trades: DataFrame, keys: Sequence[str], block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """Keep at most one open trade per series: the next entry lies after the previous exit.

    ``trades`` is read twice; block functions and the tree's levels are narrow and written once each. No task
    holds a series: a block has ``block`` entries at most, a node the arrival points of ``fanout`` children.
    """
    keys = list(keys)
    pairs = F.array_sort(F.collect_list(F.struct("entry_idx", "exit_idx")))
    blocks = (
        trades.groupBy(*keys, F.floor(F.col("entry_idx") / block).alias("node")).agg(pairs.alias("_p"))
        .select(*keys, "node", F.col("_p.entry_idx").alias("entries"), F.col("_p.exit_idx").alias("exits"))
        .withColumn("outs", _block_outs("entries", "exits"))
    )
    blocks = stored_once(blocks, "chain-blocks")
    # The last index with an entry: what lies beyond it needs no block.
    last = blocks.groupBy(*keys).agg(F.max(F.element_at("entries", -1)).alias("last"))
    largest = last.agg(F.max("last")).first()[0] or 0
    arrivals = last.select(*keys, F.lit(0).cast("bigint").alias("point"))
    if largest >= block:
        last = stored_once(last, "chain-ends")
        arrivals = _arrivals(blocks, last, arrivals, keys, block, fanout, largest)
    arrived = arrivals.withColumn("node", F.floor(F.col("point") / block))
    chosen = blocks.join(arrived, [*keys, "node"]).select(*keys, F.explode(_block_chain("entries", "exits", "point")).alias("entry_idx"))
    return trades.join(chosen, [*keys, "entry_idx"], "left_semi")


def _arrivals(blocks: DataFrame, last: DataFrame, top: DataFrame, keys: list[str], block: int, fanout: int, largest: int) -> DataFrame:
    """(keys, point): where the chain of each series arrives at each of its blocks."""
    end = lambda width: (F.col("node") + 1) * width
    jumps = blocks.select(*keys, (F.col("node") * block).alias("point"), F.explode(F.array_distinct("outs")).alias("out")).select(*keys, "point", (F.col("out") + 1).alias("after"))
    points = _points(jumps, keys, block, last)
    empty = F.array().cast(_LONGS)
    filled = points.join(blocks.select(*keys, "node", "entries", "outs"), [*keys, "node"], "left")
    after = _block_steps(F.coalesce("entries", empty), F.coalesce("outs", empty), F.col("points"), end(block))
    moves = stored_once(filled.select(*keys, F.explode(F.arrays_zip("points", after.alias("after"))).alias("m")).select(*keys, F.col("m.points").alias("point"), F.col("m.after").alias("after")), "chain-moves")
    width, grown = block, []
    while True:
        width *= fanout
        table = moves.groupBy(*keys, F.floor(F.col("point") / width).alias("node")).agg(F.array_sort(F.collect_list(F.struct("point", "after"))).alias("m"))
        table = table.select(*keys, "node", F.col("m.point").alias("points"), F.col("m.after").alias("after"))
        grown.append((width, table))
        if width > largest:
            break
        wanted = _points(moves, keys, width, last).withColumnRenamed("points", "wanted")
        composed = table.join(wanted, [*keys, "node"]).select(*keys, "wanted", _composed("points", "after", "wanted").alias("after"))
        moves = stored_once(composed.select(*keys, F.explode(F.arrays_zip("wanted", "after")).alias("m")).select(*keys, F.col("m.wanted").alias("point"), F.col("m.after").alias("after")), "chain-moves")
    for width, table in reversed(grown):
        placed = top.withColumn("node", F.floor(F.col("point") / width)).join(table, [*keys, "node"])
        # A chain that is past the last entry of its series stops.
        seen = _visited("points", "after", "point", F.least(end(width), F.col("last") + 1))
        top = placed.join(last, keys).select(*keys, F.explode(seen).alias("point"))
    return top
