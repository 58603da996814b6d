"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a slice of a partition's documents. Its symbols are the benchmark's words;
a run of other words is one separator, which no window contains, so the index holds
all that can match. Windows are searched backwards through the wavelet ranks, their
occurrences located by sampled suffix positions and merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from candlewick.llm.common import buffers, extended, ranges, stored, strings, text_hashes, text_slices, trimmed
from candlewick.llm.fm_index import FMIndex
from candlewick.llm.lsh_forest import _LOWER, word_spans

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text searched in one pass over the documents; more is searched in further passes.
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<first_word: int, end_word: int, begin: int, end: int>>"
_SPAN = pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "begin", "end")])
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Windows:
    """Distinct windows as right-aligned word numbers from 1, and the items each belongs to."""

    words: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    item_bounds: np.ndarray
    item_names: list[str]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffers(strings(column))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    begins, ends, bounds = word_spans(data, offsets, _GAP)
    return text_hashes(_LOWER[data], begins, ends), begins, ends, bounds


def windows_of(texts: list[str | None], names: list[str | None], window: int = WINDOW) -> Windows:
    hashes, _, _, bounds = _words(pa.array(texts, pa.large_string()))
    words, number = np.unique(hashes, return_inverse=True)
    sizes = np.diff(bounds)
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - window + 1))
    at, owner = ranges(bounds[:-1], counts), np.repeat(np.arange(len(sizes)), counts)
    lengths = np.minimum(window, sizes[owner])
    patterns = np.zeros((len(at), window), np.int64)
    for back in range(window):
        live = lengths > back
        patterns[live, window - 1 - back] = number[(at + lengths - 1 - back)[live]] + 1
    distinct, first, inverse = np.unique(patterns, axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([inverse.ravel(), owner], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    known = sorted({x for x in names if x is not None})
    number_of = {x: i for i, x in enumerate(known)}
    place = np.array([number_of.get(x, -1) for x in names], np.int64)
    return Windows(words, distinct, lengths[first] if len(at) else np.zeros(0, np.int64), place[pairs[:, 1]], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), known)


def search_shard(data: np.ndarray, offsets: np.ndarray, wanted: Windows) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """(n_words, spans, item names) of every text of a shard."""
    begins, ends, bounds = word_spans(data, offsets, _GAP)
    rows = len(offsets) - 1
    spans: list[list[dict]] = [[] for _ in range(rows)]
    items: list[list[str]] = [[] for _ in range(rows)]
    if not len(wanted.patterns) or not len(begins):
        return np.diff(bounds), spans, items
    hashes = text_hashes(_LOWER[data], begins, ends)
    at = np.minimum(np.searchsorted(wanted.words, hashes), len(wanted.words) - 1)
    symbol = np.where(wanted.words[at] == hashes, at + 1, 0)
    # One separator for a run of other words, and one before every text.
    opens = np.zeros(len(symbol) + 1, bool)
    opens[bounds[:-1]] = True
    opens = opens[:-1]
    keep = (symbol > 0) | opens | np.concatenate([[True], symbol[:-1] > 0])
    parted = keep & opens & (symbol > 0)  # a text that begins with a word of the benchmark: put a separator before it
    repeat = np.where(parted, 2, 1)[keep]
    word_at = np.repeat(np.flatnonzero(keep), repeat)
    reduced = symbol[word_at]
    reduced[(np.cumsum(repeat) - repeat)[repeat == 2]] = 0
    index = FMIndex(reduced, len(wanted.words))
    low, high = index.search(wanted.patterns, wanted.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    place = word_at[index.locate(ranges(low[found], counts))] if len(found) else np.zeros(0, np.int64)
    pattern = np.repeat(found, counts)
    change = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + wanted.lengths[pattern], -1)
    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
    for a, b in zip(first.tolist(), last.tolist()):
        while a < b:  # a run may go on into the next text
            row = int(np.searchsorted(bounds, a, "right")) - 1
            stop = min(b, int(bounds[row + 1]))
            spans[row].append({"first_word": a - int(bounds[row]), "end_word": stop - int(bounds[row]), "begin": int(begins[a] - offsets[row]), "end": int(ends[stop - 1] - offsets[row])})
            a = stop
    row = np.searchsorted(bounds, place, "right") - 1
    pairs = np.unique(np.stack([row, pattern], 1), axis=0)
    sizes = np.diff(wanted.item_bounds)[pairs[:, 1]]
    named = wanted.items[ranges(wanted.item_bounds[pairs[:, 1]], sizes)]
    for r, name in np.unique(np.stack([np.repeat(pairs[:, 0], sizes), named], 1), axis=0).tolist():
        if name >= 0:
            items[r].append(wanted.item_names[name])
    return np.diff(bounds), spans, items


def merged(one: list[dict], two: list[dict]) -> list[dict]:
    """The union of two lists of spans of one text."""
    out: list[dict] = []
    for span in sorted([*one, *two], key=lambda s: s["first_word"]):
        if out and span["first_word"] <= out[-1]["end_word"]:
            if span["end_word"] > out[-1]["end_word"]:
                out[-1] = out[-1] | {"end_word": span["end_word"], "end": span["end"]}
        else:
            out.append(span)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (in words and bytes, merged) and items (sorted names) of benchmark windows.

    A null or empty text has no words; an item without words has no window; an item
    without a name marks words but names nothing; items with one name are one. All
    other columns stay; ones with the three names are replaced. The benchmark is searched in
    blocks of at most about ``block_bytes``, one pass over the documents each, so its
    size is bounded by nothing else.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark = docs.sparkSession
    wanted = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names, place = docs.columns, docs.columns.index(text)
    schema = extended(docs.schema, f"n_words long, spans {SPANS}, items array<string>")
    found = docs
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(windows_of([r["text"] for r in rows], [r["name"] for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=block > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop, data, offsets in text_slices(batch.column(place), SHARD_BYTES):
                    part = batch.slice(start, stop - start)
                    n_words, spans, items = search_shard(data, offsets, shared.value)
                    if again:
                        spans = [merged(a, b) for a, b in zip(part.column("spans").to_pylist(), spans)]
                        items = [sorted({*a, *b}) for a, b in zip(part.column("items").to_pylist(), items)]
                    columns = [*part.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "spans", "items"])

        found = found.mapInArrow(trimmed(run), schema)
        if block + 1 < blocks:
            found = stored(found, "searched")
    return found


def without_spans(found: DataFrame, *, text: str = "text") -> DataFrame:
    """``find_contamination``'s rows with the spans cut out of the text; rows with no word left go."""
    names, place = found.columns, found.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw, at, kept = texts[i].encode(), 0, []
                    for span in spans:
                        kept.append(raw[at : span["begin"]])
                        at = span["end"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            columns = [pa.array(texts, batch.schema.field(place).type) if j == place else c for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.filter((F.size("spans") == 0) | (covered < F.col("n_words"))).mapInArrow(trimmed(run), found.schema)
