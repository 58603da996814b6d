"""Running counts of state flips over walks of any length: vectors of counters scanned by block.

A step's outcome is known ``horizon`` steps later. Every block counts, in one Arrow pass over narrow rows,
how often the outcome of each state bucket became known and how often it was a flip;
sums of earlier blocks enter a block as its first row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from candlewick.operators.indicators import whole_blocks
from candlewick.operators.recurrences import states_before
from candlewick.operators.series import halo_blocks
from candlewick.session import stored_once

_COUNTS = (StructField("changed", BooleanType()), StructField("order_lost", BooleanType()), *[StructField(c, LongType()) for c in ("n_hist", "hits", "then_n", "then_hits")])


class _Segments:
    """Rows of whole blocks, laid end to end: where each begins, and the events in it."""

    def __init__(self, table: pa.Table, horizon: int):
        column = lambda c: table[c].to_numpy()
        idx, block, self.marker = column("idx"), column("block"), column("marker")
        self.core = column("core")
        self.start = np.flatnonzero(np.concatenate([[True], (np.diff(idx) != 1) | (np.diff(block) != 0)]))
        sizes = np.diff(np.append(self.start, len(idx)))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(idx)) - self.start[self.owner] - self.marker[self.start][self.owner]
        self.bucket, regime, way = column("bucket"), column("regime"), column("way")
        back = np.maximum(np.arange(len(idx)) - horizon, 0)
        self.known, self.back = place >= horizon, back
        self.changed = (regime[back] != regime) | ((regime == 0) & (way[back] != way))
        order = column("order")
        before = np.maximum(np.arange(len(idx)) - 1, 0)
        self.lost = (place >= 1) & (order[before] > 0) & (order[before] != order)

    def first_cores(self) -> np.ndarray:
        """The first core row of each block; a block that is all halo has none."""
        return np.flatnonzero(self.core & np.concatenate([[True], ~self.core[:-1] | (self.owner[1:] != self.owner[:-1])]))

    def counters(self, buckets: int) -> np.ndarray:
        """Running (events, flips) by bucket over all rows, 2 * ``buckets`` columns."""
        at = np.flatnonzero(self.known)
        then = self.bucket[self.back[at]]
        ones = np.zeros((len(self.bucket), 2 * buckets), np.int64)
        ones[at, then] = 1
        ones[at, buckets + then] = self.changed[at]
        return np.cumsum(ones, axis=0)


def flip_counts(steps: DataFrame, keys: Sequence[str], horizon: int, buckets: int, block: int) -> DataFrame:
    """keys, pos, changed, order_lost, n_hist, hits, then_n, then_hits of every step.

    ``steps``: keys, pos from 0, and codes ``bucket`` (below ``buckets``), ``regime`` (0 is a trend), ``way`` and
    ``order`` (0 is none). ``n_hist`` outcomes of the step's own bucket were known by then, ``hits`` of them flips; ``then_*`` are those
    of the step ``horizon`` back, null where there is none, as is ``changed``, whether that step's label has changed.
    """
    keys = list(keys)
    codes = ("bucket", "regime", "way", "order")
    narrow = steps.select(*keys, F.col("pos").cast("long").alias("idx"), *[F.col(c).cast("int").alias(c) for c in codes])
    rows = halo_blocks(narrow, before=2 * horizon, size=block).withColumns({"marker": F.lit(0), "state": F.lit(None).cast(ArrayType(DoubleType()))})
    laid = lambda df: df.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "idx")
    largest = narrow.agg(F.max("idx")).first()[0] or 0
    if largest >= block:
        schema = StructType([*[rows.schema[c] for c in (*keys, "block")], StructField("b", ArrayType(DoubleType()))])
        arrow = to_arrow_schema(schema)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_blocks(batches):
                part = _Segments(table, horizon)
                counts = np.concatenate([np.zeros((1, 2 * buckets), np.int64), part.counters(buckets)])
                first = part.first_cores()
                own = (counts[np.append(part.start[1:], len(part.core))[part.owner[first]]] - counts[first]).astype(float)
                kept = [table[c].take(pa.array(first)).combine_chunks() for c in (*keys, "block")]
                yield from pa.Table.from_arrays([*kept, pa.array(list(own), pa.list_(pa.float64()))], schema=arrow).to_batches()

        maps = laid(rows).mapInArrow(totals, schema).withColumn("a", F.array_repeat(F.lit(1.0), 2 * buckets))
        before = states_before(stored_once(maps, "flip-totals"), keys, 2 * buckets).filter(F.col("block") > 0)
        first = before.select(
            *keys, (F.greatest(F.col("block") * block - 2 * horizon, F.lit(0)) - 1).cast("long").alias("idx"), *[F.lit(0).alias(c) for c in codes], "block", F.lit(False).alias("core"), F.lit(1).alias("marker"), "state"
        )
        rows = rows.unionByName(first)
    out = StructType([*[rows.schema[c] for c in (*keys, "idx")], *_COUNTS])
    arrow_out = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches):
            part = _Segments(table, horizon)
            counts = np.concatenate([np.zeros((1, 2 * buckets), np.int64), part.counters(buckets)])
            # What the block has before its first core row: the state of earlier blocks, wherever in the halo we stand.
            first = part.first_cores()
            base = np.zeros((len(part.start), 2 * buckets), np.int64)
            base[part.owner[first]] = -counts[first]
            marked = np.flatnonzero(part.marker)
            if len(marked):
                states = table["state"].take(pa.array(marked)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(marked), -1)
                base[part.owner[marked]] += np.rint(states).astype(np.int64)
            rows_at = np.arange(len(part.owner))
            n, hits = (counts[rows_at + 1, part.bucket + side] + base[part.owner, part.bucket + side] for side in (0, buckets))
            at = np.flatnonzero(part.core)
            back, unknown = part.back[at], ~part.known[at]
            made = [pa.array(part.changed[at], mask=unknown), pa.array(part.lost[at]), pa.array(n[at]), pa.array(hits[at]), pa.array(n[back], mask=unknown), pa.array(hits[back], mask=unknown)]
            kept = [table[c].take(pa.array(at)).combine_chunks() for c in (*keys, "idx")]
            yield from pa.Table.from_arrays([*kept, *made], schema=arrow_out).to_batches()

    return laid(rows).mapInArrow(count, out).withColumnRenamed("idx", "pos")
