"""Byte-balanced shards by histogram sort, in DataFrame functions only.

Rows are ordered by a 64-bit key: the upper bits of the text's hash, so that copies
stand together, and below them a hash of the row, so that a group of copies of any
size can still be cut. Splitters are found by counting exactly how many bytes lie
below candidate boundaries and refining only the buckets in which a target still
lies, until each boundary meets the tolerance or is exact. Then rows move once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import crc, stored

SHARDS = 24
#: Ranges a shard is cut into, so that its rows are numbered by several tasks.
RANGES = 8
#: A boundary may miss its target by this part of a shard.
TOLERANCE = 0.001
ROW_BITS = 20
PROBE_BITS = 12
#: Bytes a row weighs besides its text.
ROW_BYTES = 8


def weighed(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, __key) of every row."""
    content = F.coalesce(F.col(text), F.lit(""))
    mask = (1 << ROW_BITS) - 1
    row = F.xxhash64(key, F.monotonically_increasing_id()).bitwiseAND(F.lit(mask))
    order = F.xxhash64(content).bitwiseAND(F.lit(~mask)).bitwiseOR(row)
    return docs.select(key, (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"), crc(content).alias("text_crc32"), order.alias("__key"))


def splitters(rows: DataFrame, parts: int, tolerance: float) -> list[int]:
    """Ascending keys that cut the bytes of ``rows`` into ``parts`` near equal ranges.

    ``tolerance`` is in parts. The driver sees at most 2^PROBE_BITS sums per open target.
    """
    bits, step = 64 - PROBE_BITS, PROBE_BITS
    total, found = 0, {}
    # Target number -> (bytes below its bucket, the bucket) of what is still open.
    open_at: dict[int, tuple[int, int | None]] = dict.fromkeys(range(1, parts), (0, None))
    while open_at:
        probe = F.shiftright("__key", bits)
        inside = sorted({b for _, b in open_at.values() if b is not None})
        part = rows.filter(F.shiftright("__key", bits + step).isin(inside)) if inside else rows
        sums = sorted((r.b, r.n) for r in part.groupBy(probe.alias("b")).agg(F.sum("size").alias("n")).collect())
        total = total or sum(n for _, n in sums)
        if not total:
            return []
        below = {}  # parent bucket -> its buckets with the bytes below them
        for b, n in sums:
            row = below.setdefault(b >> step if inside else None, [[], [], []])
            row[2].append((row[2][-1] + row[1][-1]) if row[0] else 0)
            row[0].append(b)
            row[1].append(n)
        following = {}
        for j, (base, parent) in open_at.items():
            buckets, sizes, before = below[parent]
            target = total * j / parts
            i = max(0, bisect_right([base + x for x in before], target) - 1)
            low, high = base + before[i], base + before[i] + sizes[i]
            if min(target - low, high - target) <= tolerance * total / parts or bits == 0:
                found[j] = (buckets[i] + (high - target < target - low)) << bits
            else:
                following[j] = (low, buckets[i])
        open_at = following
        step = min(bits, PROBE_BITS)
        bits -= step
    return [found[j] for j in range(1, parts)]


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above the key, by halving."""

    def choose(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), choose(low, middle)).otherwise(choose(middle + 1, high))

    return choose(0, len(bounds))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, *, tolerance: float = TOLERANCE, ranges: int = RANGES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, shard, slot: shards of near equal bytes, rows numbered from 0 in key order.

    Copies of a text share a shard unless a boundary must fall among them. A null text
    weighs ``ROW_BYTES``; repeated rows are rows of their own; a null key is a key. An
    empty table gives no rows.
    """
    rows = stored(weighed(docs, text=text, key=key), "weighed")
    bounds = [b for b in splitters(rows, shards * ranges, tolerance * ranges) if b < 1 << 63]
    dealt = rows.withColumn("__range", range_of(F.col("__key"), bounds))
    counts = {r["__range"]: r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}  # a row per range
    first, offsets = 0, []
    for i in range(shards * ranges):
        first = 0 if i % ranges == 0 else first
        offsets.append(first)
        first += counts.get(i, 0)
    order = Window.partitionBy("__range").orderBy("__key", key, "text_crc32")
    slot = F.row_number().over(order) - 1 + F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__range") + 1)
    placed = dealt.repartition(shards * ranges, "__range").withColumn("slot", slot.cast("long"))
    return placed.select(key, "size", "text_crc32", F.floor(F.col("__range") / ranges).cast("int").alias("shard"), "slot")
