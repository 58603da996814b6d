"""Repeated passages by suffix arrays: bytes covered by a long string that starts elsewhere too.

Every string of ``LIMIT`` bytes has an anchor, the least hash of its ``GRAM``-byte
substrings, which depends on nothing but the string; equal strings meet under equal
anchors. Consecutive strings with one anchor form a segment. Anchors are counted over
the whole corpus, and only segments whose anchor comes twice (a fixed-size filter lets
few others pass) are made distinct where they stand and dealt, by anchor, to shards. A shard
sorts the suffixes of its segments by external induced sorting (``induced_sort``), whose
common-prefix values tell which strings start twice. The runs to remove are joined back
to the segment's occurrences by its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from candlewick.llm.common import FILTER_BITS, SLICE_BYTES, buffers, extended, filter_places, may_contain, mixed, powers, prefix_sums, ranges, strings, text_slices, trimmed
from candlewick.llm.induced_sort import MEMORY_BYTES, suffix_order

LIMIT = 200
GRAM = 40
#: Anchors a counting task gets, about.
ANCHORS_PER_TASK = 4_000_000
#: Distinct segments a shard holds, about; an anchor with more of them is a shard of its own.
SHARD_BYTES = 1 << 20
RUNS = "array<struct<begin: int, end: int>>"
_RUN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every window of ``width`` values, from running picks of blocks."""
    blocks = np.concatenate([values, np.full(-len(values) % width, np.uint64(fill))]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(values) - width + 1
    return pick(behind[:windows], ahead[width - 1 : width - 1 + windows])


def _anchors(data: np.ndarray, offsets: np.ndarray, limit: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of substrings, anchor of every string, whether it lies in one text, where its text ends)."""
    n = len(data)
    if n < limit:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    anchor = _sliding(grams, limit - gram + 1, np.minimum, 2**64 - 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    return grams, anchor, np.arange(len(anchor)) + limit <= end, end


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = LIMIT, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, starts) of the segments of all texts of a slice; no segment crosses a text's end."""
    _, anchor, whole, end = _anchors(data, offsets, limit, gram)
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    inside = whole[first]
    return anchor[first[inside]], first[inside], count[inside]


def anchor_places(data: np.ndarray, offsets: np.ndarray, limit: int, gram: int) -> np.ndarray:
    """The anchor of every place that is one for some string: a repeat inside one segment counts too."""
    grams, anchor, whole, _ = _anchors(data, offsets, limit, gram)
    if not len(anchor):
        return anchor
    width = limit - gram + 1
    none = np.zeros(width - 1, np.uint64)
    largest = _sliding(np.concatenate([none, np.where(whole, anchor, np.uint64(0)), none]), width, np.maximum, 0)
    return grams[largest == grams]


def anchor_parts(values: np.ndarray, parts: int) -> np.ndarray:
    """The counting part of each anchor. Anchors are minima, so their leading bits are nearly always zero: they are mixed again."""
    return (mixed(values) >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64)


def repeated_anchors(texts: DataFrame, limit: int, gram: int) -> np.ndarray:
    """A filter of the anchors that come more than once in the corpus.

    A task sends each anchor of its texts at most twice, packed by part; a counting task
    holds one part at a time, about ANCHORS_PER_TASK anchors, and fills the filter's slices.
    """
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    expected = 2 * size // (limit - gram + 1) + 1
    bits = 1 << max(FILTER_BITS[0], min(FILTER_BITS[1], expected.bit_length() + 2))
    parts = 1 << min(20, max(6, (expected // ANCHORS_PER_TASK).bit_length()))
    slices = min(parts, 64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values = np.repeat(values, np.minimum(times, 2))
            part = anchor_parts(values, parts)
            order = np.argsort(part, kind="stable")
            values, part = values[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edges))
            blobs = [values[edges[i] : edges[i + 1]].tobytes() for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "anchors"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES // 2):
                values, times = np.unique(anchor_places(data, offsets, limit, gram), return_counts=True)
                held.append(np.repeat(values, np.minimum(times, 2)))
                count += len(held[-1])
                if count > ANCHORS_PER_TASK:
                    yield packed()
                    held, count = [], 0
        if held:
            yield packed()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of the anchors that come twice, as packed words; parts come whole, one after the other."""
        found = np.zeros(bits // 8, np.uint8)
        held: list[np.ndarray] = []
        last = None

        def count() -> None:
            values = np.sort(np.concatenate(held))
            twice = np.unique(values[1:][values[1:] == values[:-1]])
            for at in filter_places(twice.view(np.int64), bits):
                np.bitwise_or.at(found, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and part != last:
                    count()
                    held = []
                last = part
                held.append(np.frombuffer(blob.as_buffer(), np.uint64))
        if held:
            count()
        for s, own in enumerate(found.reshape(slices, -1)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = found.setdefault(s, np.zeros(bits // slices // 8, np.uint8))
                own |= np.frombuffer(blob.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["slice", "bits"])

    counted = texts.select("__text").mapInArrow(trimmed(gather), "part long, anchors binary").repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(fill), "slice int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in counted.repartition(slices, "slice").mapInArrow(trimmed(unite), "slice int, bits binary").collect():  # the filter, of bounded size
        first = row["slice"] * (bits // slices // 8)
        out[first : first + bits // slices // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def repeated_runs(texts: list[bytes], counts: np.ndarray, several: np.ndarray, limit: int, memory: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment the runs (first, last) of its starts that start elsewhere too.

    ``several`` marks segments that stand in more than one place.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    # Bytes of UTF-8 end at 0xF4, so 2 can be added; 1 ends a segment and 0 the shard.
    whole = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8) + np.uint8(2)
    order, common = suffix_order(np.append(whole, np.uint8(0)), limit, memory)
    same = common >= limit
    again = np.zeros(len(whole) + 1, bool)
    again[order[same | np.append(same[1:], False)]] = True
    out = []
    for place, count, repeated in zip(at.tolist(), counts.tolist(), several.tolist()):
        flags = np.concatenate([[False], np.ones(count, bool) if repeated else again[place : place + count], [False]])
        edge = np.flatnonzero(flags[1:] != flags[:-1])
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist())))
    return out


def _digests(pieces: list[bytes]) -> list[pa.Array]:
    """128 bits of every segment, as two columns."""
    both = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _chosen(batch: pa.RecordBatch, wanted: np.ndarray, limit: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, end row, offsets, anchors, first starts, numbers of starts, segments) of the segments that may come twice."""
    for start, stop, data, offsets in text_slices(batch.column(0), SLICE_BYTES // 2):
        anchor, first, count = segments(data, offsets, limit, gram)
        kept = np.flatnonzero(may_contain(wanted, anchor.view(np.int64)))
        if len(kept):
            anchor, first, count = anchor[kept], first[kept], count[kept]
            raw = data.tobytes()
            yield start, stop, offsets, anchor, first, count, [raw[i:j] for i, j in zip(first.tolist(), (first + count + limit - 1).tolist())]


def distinct_segments(texts: DataFrame, wanted: Broadcast, limit: int, gram: int) -> DataFrame:
    """(anchor, piece, times) of the segments whose anchor may come twice, a few rows each however often they stand in the texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, segment, times) of about SHARD_BYTES of distinct segments at a time; times are at most two."""
        seen: dict[bytes, list[int]] = {}
        held = 0

        def packed() -> pa.RecordBatch:
            counts = np.array(list(seen.values()), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(counts[:, 0]), pa.array(list(seen), pa.binary()), pa.array(counts[:, 1])], names=["anchor", "piece", "times"])

        for batch in batches:
            for _, _, _, anchor, _, _, pieces in _chosen(batch, wanted.value, limit, gram):
                for own, piece in zip(anchor.view(np.int64).tolist(), pieces):
                    known = seen.get(piece)
                    if known is None:
                        seen[piece] = [own, 1]
                        held += len(piece)
                    else:
                        known[1] = 2
                if held > SHARD_BYTES:
                    yield packed()
                    seen, held = {}, 0
        if seen:
            yield packed()

    return texts.select("__text").mapInArrow(trimmed(distinct), "anchor long, piece binary, times long")


def removal_runs(texts: DataFrame, limit: int, gram: int, memory: int) -> DataFrame:
    """(__key, __hash, runs) of the documents that have bytes to remove; the runs of a row may overlap.

    Shards get distinct segments with their counts, never a row for every occurrence;
    their runs are joined back to the occurrences, which carry a digest and no bytes.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(repeated_anchors(texts, limit, gram))
    kind = texts.schema["__key"].dataType.simpleString()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, offsets, _, first, _, pieces in _chosen(batch, wanted.value, limit, gram):
                row = np.searchsorted(offsets, first, "right") - 1
                take = pa.array(row)
                own = [batch.column(i).slice(start, stop - start).take(take) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*_digests(pieces), *own, pa.array((first - offsets[row]).astype(np.int32))], names=["d1", "d2", "__key", "__hash", "first"])

    def answer(pieces: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        """Sort the distinct segments of a shard; the repeated runs of those that have some."""
        texts = list(pieces)
        starts = np.array([len(p) - limit + 1 for p in texts], np.int64)
        runs = repeated_runs(texts, starts, np.array(list(pieces.values())) > 1, limit, memory)
        full = [i for i, own in enumerate(runs) if own]
        if full:
            found = [[{"begin": a, "end": b + limit} for a, b in runs[i]] for i in full]
            yield pa.RecordBatch.from_arrays([*_digests([texts[i] for i in full]), pa.array(found, pa.list_(_RUN))], names=["d1", "d2", "runs"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor; whole anchors are gathered into shards of about SHARD_BYTES of distinct segments."""
        pieces: dict[bytes, int] = {}
        held, last = 0, None
        for batch in batches:
            for anchor, piece, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if anchor != last and held > SHARD_BYTES:
                    yield from answer(pieces)
                    pieces, held = {}, 0
                last = anchor
                if piece not in pieces:
                    held += len(piece)
                pieces[piece] = min(2, pieces.get(piece, 0) + times)
        if pieces:
            yield from answer(pieces)

    dealt = distinct_segments(texts, wanted, limit, gram).repartition("anchor").sortWithinPartitions("anchor")
    repeated = dealt.mapInArrow(trimmed(shards), f"d1 long, d2 long, runs {RUNS}")
    placed = texts.select("__text", "__key", "__hash").mapInArrow(trimmed(occurrences), f"d1 long, d2 long, __key {kind}, __hash long, first int")
    found = placed.join(repeated, ["d1", "d2"]).select("__key", "__hash", "first", F.explode("runs").alias("run"))
    run = F.struct((F.col("first") + F.col("run.begin")).alias("begin"), (F.col("first") + F.col("run.end")).alias("end"))
    return found.groupBy("__key", "__hash").agg(F.collect_list(run).alias("__runs"))


def merged_runs(runs: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in runs or ()):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((begin, end))
    return out


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs shrunk to whole characters, so that what is left is text."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for begin, end in runs:
        while inside(begin):
            begin += 1
        while inside(end):
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def repeated_passages(docs: DataFrame, limit: int = LIMIT, gram: int = GRAM, *, text: str = "text", key: str = "doc_id", memory: int = MEMORY_BYTES) -> DataFrame:
    """``docs`` with n_bytes, runs (byte ranges to remove), kept_sha256 and kept_text.

    A byte goes when a string of ``limit`` bytes that covers it also starts elsewhere,
    in its text or another; judged on the input. kept_sha256 is of the remaining bytes;
    kept_text keeps characters of which a byte remains. A null text is empty (and its
    kept_text null); a text shorter than ``limit`` loses nothing; a repeated row makes
    both its copies go. Other columns stay; ones with the four names are replaced.
    """
    docs = docs.drop("n_bytes", "runs", "kept_sha256", "kept_text")
    names, place = docs.columns, docs.columns.index(text)
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    texts = hashed.select(F.coalesce(text, F.lit("")).alias("__text"), F.col(key).alias("__key"), "__hash")
    runs = removal_runs(texts, limit, gram, memory).withColumnRenamed("__hash", "__other")
    joined = hashed.join(runs, hashed[key].eqNullSafe(runs["__key"]) & (hashed["__hash"] == runs["__other"]), "left").select(*names, "__runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(strings(batch.column(place)))
            empty = batch.column(place).is_null().to_pylist()
            sizes, runs, digests, kept = np.diff(offsets), [], [], []
            for i, given in enumerate(batch.column(len(names)).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                own = merged_runs(given)
                runs.append([{"begin": a, "end": b} for a, b in own])
                edges = [0, *(x for run in own for x in run), len(raw)]
                digests.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
                if empty[i]:
                    kept.append(None)
                else:
                    edges = [0, *(x for run in whole_characters(raw, own) for x in run), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
            added = [pa.array(sizes), pa.array(runs, pa.list_(_RUN)), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], names=[*names, "n_bytes", "runs", "kept_sha256", "kept_text"])

    return joined.mapInArrow(trimmed(cut), extended(docs.schema, f"n_bytes long, runs {RUNS}, kept_sha256 string, kept_text string"))
