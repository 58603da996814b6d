"""Importance resampling towards a target text, with bit-sliced sums.

A document is a bag of hashed features; every bucket has a gain, the scaled log ratio of its
smoothed share in the target and in the corpus. A document's counts are written as
bit planes over the buckets (plane i holds the buckets whose count has bit i), the
gains as bit planes of their positive and negative magnitudes. AND of two planes,
a popcount and a power of two per pair of planes give the exact sum of gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candlewick.llm.common import buffers, extended, stored, strings, trimmed
from candlewick.llm.positions import numbered

BUCKETS, SCALE, SEED, PERCENT, LEAST_WORDS = 10_000, 1000, 2024, 10, 20
#: Bytes of a text that become words at a time; a longer word stays whole.
PIECE_BYTES = 1 << 20

#: Lower-cases A-Z; other ASCII bytes than digits and letters become spaces, bytes of other characters stay.
_LETTERS = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by pieces that end between words."""
    start = 0
    while start < len(raw):
        end = start + PIECE_BYTES
        piece = raw[start:end].translate(_LETTERS)
        if end < len(raw):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(raw):  # a word longer than the piece
                more = raw[end : end + PIECE_BYTES].translate(_LETTERS)
                cut, end = (len(piece) + more.find(b" ") if b" " in more else -1), end + PIECE_BYTES
                piece += more
            if cut >= 0:
                piece, end = piece[:cut], start + cut + 1
        yield piece.split()
        start = end


def text_buckets(raw: bytes, grams: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to ``grams`` words that end in it, repeats included) of every piece."""
    held: list[bytes] = []
    for words in pieces(raw):
        joined = held + words
        found = []
        for size in range(1, grams + 1):
            first = max(0, len(held) - size + 1)
            runs = words if size == 1 else [b" ".join(joined[i : i + size]) for i in range(first, len(joined) - size + 1)]
            found += map(zlib.crc32, runs)
        held = joined[-(grams - 1) :] if grams > 1 else []
        yield len(words), np.array(found, np.uint32).astype(np.int64) % buckets


def bucket_totals(texts: DataFrame, text: str = "text", grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: at most ``buckets`` sums reach the driver, whatever the table holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(strings(batch.column(0)))
            for i in range(len(offsets) - 1):
                for _, found in text_buckets(data[offsets[i] : offsets[i + 1]].tobytes(), grams, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for row in texts.select(text).mapInArrow(trimmed(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative numbers, as rows of 64-bit words; no plane for none."""
    depth = int(values.max(initial=0)).bit_length()
    bits = (values >> np.arange(depth)[:, None] & 1).astype(np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    whole = np.zeros((depth, -(-len(values) // 64) * 8), np.uint8)
    whole[:, : packed.shape[1]] = packed
    return whole.view(np.uint64)


@dataclass
class Gains:
    """Gain of every bucket, and the signed planes made of them."""

    values: np.ndarray

    def __post_init__(self):
        rising, falling = planes(np.maximum(self.values, 0)), planes(np.maximum(-self.values, 0))
        self.bits = np.concatenate([rising, falling])
        self.powers = [1 << i for i in range(len(rising))] + [-(1 << i) for i in range(len(falling))]

    def total(self, counts: np.ndarray) -> int:
        """Sum of count times gain over all buckets."""
        whole = 0
        for i, plane in enumerate(planes(counts)):
            held = np.flatnonzero(plane)  # words of the plane that hold any bucket
            if len(held):
                ones = np.bitwise_count(self.bits[:, held] & plane[held]).sum(axis=1, dtype=np.int64)
                whole += sum(p * n for p, n in zip(self.powers, ones.tolist())) << i
        return whole


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> Gains:
    """floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of every bucket."""
    size, whole, wanted = float(len(corpus)), float(corpus.sum()), float(target.sum())
    ratios = ((target + 1.0) * (whole + size)) / ((corpus + 1.0) * (wanted + size))
    return Gains(np.array([math.floor(scale * math.log(r)) for r in ratios.tolist()], np.int64))


def weighted(docs: DataFrame, model: Gains, text: str = "text", grams: int = 1) -> DataFrame:
    """Rows with ``n_words``, ``n_features`` and ``weight``: the floored mean gain of a text's features, 0 for none."""
    buckets = len(model.values)
    kept = docs.drop("n_words", "n_features", "weight")
    at = kept.columns.index(text)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(strings(batch.column(at)))
            made = np.zeros((3, len(offsets) - 1), np.int64)
            for i in range(len(offsets) - 1):
                words, counts = 0, np.zeros(buckets, np.int64)
                for n, found in text_buckets(data[offsets[i] : offsets[i + 1]].tobytes(), grams, buckets):
                    words += n
                    counts += np.bincount(found, minlength=buckets)
                features = int(counts.sum())
                made[:, i] = words, features, model.total(counts) // features if features else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, "n_words", "n_features", "weight"])

    return kept.mapInArrow(trimmed(weigh), extended(kept.schema, "n_words long, n_features long, weight long"))


def perturbed(weight: Column, key: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Weight plus floored, scaled Gumbel noise that the key alone decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weight + noise.cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, text: str = "text", key: str = "doc_id", target_text: str = "text", grams: int = 1,
    buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, n_words, n_features, weight, score and rank.

    ``percent`` of the documents with at least ``least_words`` words are drawn, highest
    score first, ties to the smaller key (null first), then by the other numbers; ``rank`` counts from 1
    and is null for all others. Null and empty texts have no features and weight 0. Repeated rows are rows of
    their own, with ranks of their own. A text of any length is read in pieces of a
    MB and needs one array of ``buckets`` counts. Two passes over the texts; the model is ``buckets`` numbers.
    """
    model = gains(bucket_totals(docs, text, grams, buckets), bucket_totals(target, target_text, grams, buckets))
    scored = weighted(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, "text", grams).drop("text")
    scored = stored(scored.withColumn("score", perturbed(F.col("weight"), F.col("key"), seed)), "scored")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("key").asc_nulls_first()]
    ranked = numbered(scored.filter(able), order, name="at")
    drawn = F.when(F.col("at") < F.expr(f"at_total * {percent} div 100"), F.col("at") + 1)
    ranked = ranked.withColumn("rank", drawn).drop("at", "at_total")
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("key", key)
