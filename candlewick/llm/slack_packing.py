"""Packing token ids into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one rest. The number of rests of each
length is a histogram of at most ``capacity - 1`` entries, whatever the corpus; on it
the driver picks, window after window, the multiset of lengths whose sum comes closest
to the capacity (a bitset subset-sum program with bounded counts, the counts found by
walking the bitsets back). A multiset is used as often as its scarcest length allows,
so the plan is about as long as the histogram. Rests are numbered inside their length
and read their place from the plan.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from candlewick.llm.common import ranges, stored, text_slices, trimmed
from candlewick.llm.pretokens import Seen, pretokens, vocabulary

CAPACITY = 2048
#: Pre-tokens whose ids a task remembers.
MAX_SEEN = 400_000
#: Pre-tokens handed to the library at a time; what it returns is much larger than the ids.
ENCODED = 4096
#: Rests of one length are numbered in this many groups, so that a length that a third of all rows share spreads.
GROUPS = 64


@functools.cache
def library(path: str):
    """The tokenizer of a file, loaded once by a worker; its threads would compete with other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class IdStore:
    """Ids of distinct pre-tokens, found by hash; what is new is encoded by the tokenizer file's library."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.special = vocabulary(path)[1]
        self.seen = Seen(MAX_SEEN)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def shrink(self) -> None:
        """Keep the ids of the pre-tokens that were used last."""
        kept = self.seen.halve()
        sizes = self.size[kept]
        self.ids = self.ids[ranges(self.first[kept], sizes)]
        self.first, self.size = np.cumsum(sizes) - sizes, sizes
        self.seen.values = np.arange(len(kept))

    def encode(self, data: np.ndarray, offsets: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``tail``; offsets)."""
        if self.seen.full:
            self.shrink()
        begins, ends, hashes = pretokens(data, offsets, self.special)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        entry, known = self.seen.find(distinct)
        new = first[~known]
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(begins[new].tolist(), ends[new].tolist())]
            ids = []
            for at in range(0, len(texts), ENCODED):
                ids += [x.ids for x in self.tokenizer.encode_batch_fast(texts[at : at + ENCODED], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            entry[~known] = len(self.first) + np.arange(len(new))
            self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum())))
            self.seen.add(distinct[~known], entry[~known])
        chosen = entry[inverse]
        sizes = self.size[chosen]
        flat = self.ids[ranges(self.first[chosen], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, offsets)]
        rows = len(offsets) - 1
        out = np.full(len(flat) + rows, tail, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(rows), np.diff(bounds))] = flat
        return out, bounds + np.arange(rows + 1)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, tail: int = 1, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's full windows and its rest: key, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = IdStore(tokenizer)  # lives as long as the task: its worker goes on to other stages
        for batch in batches:
            for first, stop, data, offsets in text_slices(batch.column(1)):
                ids, bounds = store.encode(data, offsets, tail)
                totals = np.diff(bounds)
                cuts = -(-totals // capacity)
                doc = np.repeat(np.arange(stop - first), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
                length = np.minimum(capacity, totals[doc] - start)
                at = bounds[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first).take(pa.array(doc)), *map(pa.array, (start, length, crc, totals[doc]))],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("__text")).mapInArrow(trimmed(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def closest(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum that fits, found back from the bitsets."""
    mask, reach = (1 << (capacity + 1)) - 1, [1]
    for length, count in zip(lengths, counts):
        bits, left, part = reach[-1], min(count, capacity // length), 1
        while left:  # 1, 2, 4, ... copies and what is over make every number of copies
            take = min(part, left)
            bits |= (bits << (take * length)) & mask
            left -= take
            part *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, {}
    for k in range(len(reach) - 1, 0, -1):
        if reach[k - 1] >> total & 1:
            continue
        length, copies = lengths[k - 1], 0
        while not reach[k - 1] >> total & 1:
            total -= length
            copies += 1
        chosen[length] = copies
    return chosen


@dataclass(frozen=True)
class Plan:
    """Places of rests: rows sorted by (length, first); one row serves a run of ordinals of a length."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    windows: int


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fill windows for the rests counted in ``histogram``; the longest rest left is in each window."""
    left, used = dict(histogram), dict.fromkeys(histogram, 0)
    rows, windows = [], 0
    while left:
        longest = max(left)
        order = sorted(left, reverse=True)
        counts = [left[x] - (x == longest) for x in order]
        chosen = closest(order, counts, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            rows.append((x, used[x], chosen[x], windows, offset))
            offset += x * chosen[x]
            used[x] += times * chosen[x]
            left[x] -= times * chosen[x]
            if not left[x]:
                del left[x]
        windows += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, windows)


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Gapless ordinals inside ``group`` from 0, counted in salted parts so that no group meets in one task."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(GROUPS)).cast("int"))
    sizes = salted.groupBy(group, "__salt").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__salt")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order)) - 1
    return salted.withColumn("__inside", inside).join(before, [group, "__salt"]).withColumn(name, (F.col("__inside") + F.col("__before")).cast("long")).drop("__salt", "__inside", "__before")


def placed(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY, *, key: str = "doc_id") -> DataFrame:
    """``cut`` (as from ``pieces``, stored) with sequence_id and offset."""
    order = [F.col(key), F.col("start"), F.col("ids_crc32")]
    histogram = cut.filter(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n"))
    plan = minimum_slack({r.length: r.n for r in histogram.collect()}, capacity)  # at most capacity - 1 rows
    ranked = numbered(cut, "length", order, "__ordinal")
    names = [*cut.columns, "__ordinal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(plan.first.max()) + 1 if len(plan.first) else 1
        keys = plan.length * span + plan.first
        for batch in batches:
            batch = batch.select(names)
            length, ordinal = (batch.column(x).to_numpy() for x in ("length", "__ordinal"))
            sequence, offset = plan.windows + ordinal, np.zeros(len(length), np.int64)
            rest = np.flatnonzero(length < capacity)
            if len(rest):
                size, at = length[rest], ordinal[rest]
                row = np.searchsorted(keys, size * span + np.minimum(at, span - 1), "right") - 1
                past = at - plan.first[row]
                sequence[rest] = plan.base[row] + past // plan.copies[row]
                offset[rest] = plan.offset[row] + past % plan.copies[row] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(trimmed(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, tail: int = 1, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A document is its ids and ``tail``; a null or empty text is ``tail`` alone, so every
    row has at least one piece. Repeated rows are packed each on their own. Only ``key``
    and the text are read; an empty table gives no rows.
    """
    return placed(docs.sparkSession, stored(pieces(docs, tokenizer, capacity, tail, text=text, key=key), "pieces"), capacity, key=key)
