"""Language identification by bit-sliced Bloom filters of character n-grams.

A cell of the filter is a bit mask with one bit per language. An n-gram addresses a
few cells and the AND of their masks is the set of all languages that contain it. A
text counts, language by language, the bits over its n-grams; the share of bits that
chance would set (the product of the filter's fill rates) is taken off, and the
language with the largest corrected share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.llm.common import crc, extended, hash_sample, key_hash, mixed, text_slices, trimmed

SIZES = (2, 3, 4)
CELLS = 1 << 19
HASHES = 2
#: Bounds of the sample the filters are filled from: rows a language, and bytes of their whole texts.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 4 << 20
#: Languages whose hits are counted together.
MASK_BITS = 8
#: Bytes of text taken at a time, whose n-grams stay in a core's cache.
TEXT_BYTES = 128 << 10
#: Bytes of sample turned into n-grams at a time on the driver.
FILL_BYTES = 256 << 10
#: An n-gram belongs to a language in which it is at least this part as frequent as where it is most frequent.
SHARE = 0.25
#: and that has it at least so often.
LEAST = 2


def _letters() -> np.ndarray:
    """Bytes by what n-grams see: lower-case letters and bytes of other letters as they are, all else a gap."""
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_LETTERS = _letters()


def sized_ngrams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes of the n-grams of all texts in their order, offsets by text) for each size.

    Runs of other bytes are one gap; a text ends with a gap and no n-gram begins with that one, so
    n-grams of one text never reach into the next. Gaps stand only at an n-gram's ends, and n-grams
    of two gaps are left out.
    """
    rows = len(offsets) - 1
    letters = np.insert(_LETTERS[data], offsets[1:], 0)  # a gap after every text
    ends = offsets[1:] + np.arange(rows)
    lettered = letters > 0
    kept = np.ones(len(letters), bool)
    kept[1:] = lettered[1:] | lettered[:-1]
    kept[ends] = True
    letters, lettered = letters[kept], lettered[kept]
    bounds = np.concatenate([[0], np.cumsum(kept)[ends]])
    begins = np.ones(len(letters), bool)
    begins[bounds[1:] - 1] = False
    value, padded = np.zeros(len(letters), np.uint32), np.concatenate([letters, np.zeros(max(SIZES), np.uint8)])
    found = []
    for n in range(1, max(SIZES) + 1):
        value = (value << np.uint32(8)) | padded[n - 1 : n - 1 + len(letters)]
        if n > 2:
            begins[: 2 - n] &= lettered[n - 2 : len(letters)]  # a letter at each inner place
            begins[2 - n :] = False
        if n in SIZES:
            at = np.flatnonzero(begins if n > 2 else begins & lettered)
            found.append((mixed(value[at].astype(np.uint64) + np.uint64(n << 56)), np.searchsorted(at, bounds)))
    return found


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the n-grams of all texts, of all sizes, offsets by text)."""
    found = sized_ngrams(data, offsets)
    owners = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)) for _, bounds in found])
    return np.concatenate([hashes for hashes, _ in found])[np.argsort(owners, kind="stable")], sum(bounds for _, bounds in found)


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of n-grams in the filter; CELLS is a power of two."""
    return [((hashes >> np.uint64(k * 24)) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilter:
    """``masks`` holds a language's bit in every cell of its n-grams; ``chance`` is the part of unknown n-grams that hit."""

    names: list[str]
    masks: np.ndarray
    chance: np.ndarray

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """The languages of each n-gram as bit masks."""
        first, *others = cells(hashes)
        found = self.masks[first]
        for at in others:
            found = found & self.masks[at]
        return found

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many n-grams of each text each language contains, (texts, languages): masks are counted, a few bits at a time."""
        rows, found, counted = len(bounds) - 1, self.containing(hashes), []
        for first in range(0, len(self.names), MASK_BITS):
            bits = min(MASK_BITS, len(self.names) - first)
            seen = (found >> np.uint8(first)) & found.dtype.type((1 << bits) - 1)
            seen = seen + np.repeat(np.arange(rows) << bits, np.diff(bounds))
            masks = np.bincount(seen, minlength=rows << bits).reshape(rows, 1 << bits)
            counted.append(masks @ (np.arange(1 << bits)[:, None] >> np.arange(bits) & 1))
        return np.concatenate(counted, axis=1)

    def decide(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score from 0 to 1) of each text from its n-grams by size."""
        sizes = sum(np.diff(bounds) for _, bounds in found)
        hits = sum(self.hits(hashes, bounds) for hashes, bounds in found)
        share = np.clip((hits / np.maximum(1, sizes)[:, None] - self.chance) / (1 - self.chance), 0, 1)
        best = share.argmax(1)
        total = share.sum(1)
        return best, np.where(total > 0, share[np.arange(len(best)), best] / np.maximum(total, 1e-12), 1 / max(1, len(self.names)))


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, how often) of a sample, slice by slice."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()), FILL_BYTES):
        found, number = np.unique(ngrams(data, offsets)[0], return_counts=True)
        keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, number]), len(keys)).astype(np.int64)
    return keys, counts


def fill(samples: dict[str, list[str]]) -> LanguageFilter:
    """Filters of the n-grams that the sample shows to belong to each language."""
    names = sorted(samples)
    if len(names) > 64:
        raise ValueError("a mask has room for 64 languages")
    counted = [_counts(samples[name]) for name in names]
    every = np.unique(np.concatenate([keys for keys, _ in counted])) if names else np.zeros(0, np.uint64)
    rate = np.zeros((len(names), len(every)))
    number = np.zeros((len(names), len(every)), np.int64)
    for k, (keys, counts) in enumerate(counted):
        at = np.searchsorted(every, keys)
        number[k, at] = counts
        rate[k, at] = counts / max(1, counts.sum())
    member = (rate >= SHARE * rate.max(0)) & (number >= LEAST) if len(every) else rate > 0
    masks = np.zeros(CELLS, np.min_scalar_type((1 << max(1, len(names))) - 1))  # narrow masks stay in a core's cache
    for k in range(len(names)):
        for at in cells(every[member[k]]):
            masks[np.unique(at)] |= masks.dtype.type(1 << k)
    bits = [(masks >> np.uint8(k)) & np.uint8(1) for k in range(len(names))]
    return LanguageFilter(names, masks, np.array([min(0.99, float(b.mean()) ** HASHES) for b in bits]))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> LanguageFilter:
    """Filters filled from at most ``sample_rows`` rows and ``sample_bytes`` bytes of each language.

    Whole texts are taken in the order of a hash of their key. Rows without text or
    language teach nothing. All texts are read once for their sizes, which are kept while languages are sampled.
    """
    given = docs.select(key, F.col(text).alias("__text"), F.col(lang).alias("__lang")).filter("__text is not null and __lang is not null")
    fitting = given.filter(F.octet_length("__text") <= sample_bytes)
    told = given.select("__lang", key_hash(key).alias("h"), F.octet_length("__text").alias("n")).persist()
    samples = {}
    names = [r["__lang"] for r in told.select("__lang").distinct().limit(65).collect()]
    for name in names:
        spoken = F.col("__lang") == name
        rows = hash_sample(fitting.filter(spoken), told.filter(spoken & (F.col("n") <= sample_bytes)), sample_rows, sample_bytes, key=key)
        samples[name] = [r["__text"] for r in rows]
    told.unpersist()
    return fill(samples)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageFilter, *, text: str = "text", unknown: str = "und", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone.

    A null text, one without a letter, and every text of a model without languages are
    ``unknown`` with score 0. All other columns stay; ones named lang_pred or score are
    replaced. The filter has a fixed size and is broadcast once. Without ``keep_text`` texts do not travel back.
    """
    docs = docs.drop("lang_pred", "score")
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, unknown], object)
        for batch in batches:
            for start, stop, data, offsets in text_slices(batch.column(place), TEXT_BYTES):
                part = batch.slice(start, stop - start)
                lettered = pc.fill_null(pc.match_substring_regex(part.column(place), r"\pL"), False).to_numpy(zero_copy_only=False)
                if model.names:
                    best, score = model.decide(sized_ngrams(data, offsets))
                else:
                    best, score = np.zeros(stop - start, np.int64), np.zeros(stop - start)
                lettered = lettered & bool(model.names)
                chosen = names[np.where(lettered, best, len(model.names))]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(chosen, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(trimmed(run), extended(docs.select(*kept).schema, "lang_pred string, score double"))


def held_out(key: str = "doc_id"):
    return crc(F.col(key)) % 5 == 0
