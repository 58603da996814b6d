"""Helpers the operators share: Arrow text buffers, span hashes and scratch tables."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from candlewick.session import fresh_path

#: Bytes of text a task turns into numpy arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB: documents are rows of several kB, some of very many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at its end the worker, which outlives the task, gives freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


def crc(column: Column) -> Column:
    """Unsigned CRC-32 of a value's text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def key_hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def hash_sample(df: DataFrame, told: DataFrame, rows: int, size: int, *, key: str = "doc_id") -> list[Row]:
    """At most ``rows`` rows with at most ``size`` bytes of text, taken in the order of a hash of their key.

    ``told``: hash h and bytes n of each row. Only these are ordered; the texts that travel are those of the sample.
    """
    order = key_hash(key)
    first = told.select("h", "n").orderBy("h", "n").limit(rows).collect()
    taken, total = 0, 0
    while taken < len(first) and total + first[taken]["n"] <= size:
        total += first[taken]["n"]
        taken += 1
    if not taken:
        return []
    return df.filter(order <= first[taken - 1]["h"]).limit(taken).collect()


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null read as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a large-string array, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offsets = buffers(strings(column))
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, rows)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    v = values ^ (values >> np.uint64(32))
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return v


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; made anew, since a worker outlives the slice that needs them."""
    with np.errstate(over="ignore"):
        up = np.full(size, _BASE)
        down = np.full(size, _INVERSE)
        up[:1] = down[:1] = 1
        return np.cumprod(up), np.cumprod(down)


#: Longer spans are hashed one by one.
_WIDE = 512


def text_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time go through a non-linear step.

    Spans of up to eight bytes and one length have different hashes; others share one with the
    chance of random numbers, whatever their structure (unlike sums of powers).
    """
    lengths = (ends - begins).astype(np.int64)
    out = mixed(lengths.astype(np.uint64) * _BASE + np.uint64(1))
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    live, at = np.flatnonzero((lengths > 0) & (lengths <= _WIDE)), 0
    while len(live):
        read = np.ascontiguousarray(eights[begins[live] + at]).view(np.uint64).ravel()
        read &= masks[np.minimum(lengths[live] - at, 8)]
        out[live] = mixed(out[live] ^ mixed(read + np.uint64((at + 1) * int(_BASE) % 2**64)))
        at += 8
        live = live[lengths[live] > at]
    for i in np.flatnonzero(lengths > _WIDE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def prefix_sums(data: np.ndarray, up: np.ndarray | None = None) -> np.ndarray:
    """Polynomial prefix sums modulo 2^64 of bytes, one longer than ``data``: for choices, not for equality."""
    up = powers(len(data) + 1)[0] if up is None else up
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of spans, equal for equal contents wherever they stand; some unequal ones of long regular contents are equal too.

    ``down``: inverse powers, where a caller hashes several sets of spans.
    """
    down = powers(len(sums))[1] if down is None else down
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def extended(schema: StructType, added: str) -> StructType:
    """``schema`` and the columns of a DDL string."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


#: A filter has about 16 bits an entry, at least and at most these powers of two.
FILTER_BITS = (20, 27)
_SLICES = 64


def membership(values: DataFrame, expected: int) -> np.ndarray:
    """A Bloom filter (packed bits, two per entry) of a table's one long column.

    Its slices are filled by separate tasks; what reaches the driver is the filter, whose
    size is bounded by FILTER_BITS whatever the table holds. A fuller filter lets more
    pass, so it only ever spares work: users check again what passed.
    """
    bits = 1 << max(FILTER_BITS[0], min(FILTER_BITS[1], (16 * max(1, expected)).bit_length()))
    width = bits // _SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slices, places = (batch.column(i).to_numpy() for i in (0, 1))
            for s in np.unique(slices).tolist():
                found.setdefault(s, np.zeros(width, bool))[places[slices == s]] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "bits"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(filter_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int64))], names=["slice", "place"])

    dealt = values.mapInArrow(trimmed(places), "slice int, place long").repartition(_SLICES, "slice")
    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(trimmed(fill), "slice int, bits binary").collect():
        first = row["slice"] * width // 8
        out[first : first + width // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def filter_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    hashed = mixed(values.astype(np.int64).view(np.uint64) * _BASE + np.uint64(1))
    return [(hashed % np.uint64(bits)).astype(np.int64), ((hashed >> np.uint64(32)) * _BASE >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)]


def may_contain(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter; false is certain."""
    found = np.ones(len(values), bool)
    for at in filter_places(values, 8 * len(packed)):
        found &= packed[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    return found
