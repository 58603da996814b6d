"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself and of its first bytes; filters of
several widths slide over the words, the largest answer of each filter over the whole
text feeds a logistic output. Thresholds are calibrated by language: the language is
read off the text by hashed word counts, and the log odds are moved so that each
language's threshold falls on ``CUT``.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.llm.common import SLICE_BYTES, crc, extended, powers, prefix_sums, ranges, span_hashes, text_slices, trimmed

BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Lengths in bytes of the word beginnings that have embeddings too.
BEGINNINGS = (4, 6)
CUT = 0.7
#: Bytes of text turned into words at a time, so that arrays stay in a core's cache.
TEXT_BYTES = 256 << 10
#: Bytes of text a task trains on, about, between two averages of all tasks' models, and the number of averages.
PART_BYTES = 8 << 20
ROUNDS = 4
#: Passes over all texts; a small table is passed over until LEAST_STEPS batches or MOST_BYTES of text a part are seen.
EPOCHS = 4
LEAST_STEPS, MOST_BYTES = 400, 64 << 20
BATCH = 32
#: Part of the words left out of a training text, so that no few words carry its label.
DROPPED = 0.3
#: One in so many texts is kept from training and sets the thresholds, where either label has LEAST_HELD texts at least.
CALIBRATION = 4
LEAST_HELD = 20
#: Log odds are counted in steps of 1 / BINS up to BOUND for the thresholds; averages are exact sums of multiples of 1 / UNIT.
BINS, BOUND = 256, 64
UNIT = 1 << 20
_SCALE = 0.1
_CUT_ODDS = float(np.log(CUT / (1 - CUT)))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lower()
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word: rows (word, beginnings), offsets of the texts in words)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    edge = inside[1:] != inside[:-1]
    edge[offsets[1:-1]] |= inside[1:-1][np.minimum(offsets[1:-1], len(data) - 1)] if len(data) else False
    begins = np.flatnonzero(edge[:-1] & inside[1:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(edge & inside[:-1])
    if len(begins) != len(ends):  # a text ends inside letters and the next begins with letters
        cuts = offsets[1:-1]
        ends = np.union1d(ends, cuts[inside[cuts] & inside[cuts + 1]])
    up, down = powers(len(data) + 1)
    sums = prefix_sums(_LOWER[data], up)
    rows = [span_hashes(sums, begins, ends, down)]
    for k, size in enumerate(BEGINNINGS):
        rows.append(span_hashes(sums, begins, np.minimum(begins + size, ends), down) ^ np.uint64(k + 1))
    return np.stack([(r % np.uint64(BUCKETS)).astype(np.int32) for r in rows]), np.searchsorted(begins, offsets)


@dataclass
class Classifier:
    """Embeddings, filters by width, output weights, language counts and thresholds."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: np.ndarray
    thresholds: np.ndarray

    def pooled(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(largest answer of each filter over each text, embedded words, all answers); texts without words answer 0."""
        embedded = np.take(self.embedding, words[0], axis=0)
        for beginning in words[1:]:
            embedded += np.take(self.embedding, beginning, axis=0)
        out, answers = np.zeros((len(bounds) - 1, len(WIDTHS) * FILTERS), np.float32), []
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        for k, (width, kernel) in enumerate(zip(WIDTHS, self.filters)):
            padded = np.zeros((len(embedded) + width - 1, DIM), np.float32)
            padded[: len(embedded)] = embedded
            answer = np.zeros((len(embedded), FILTERS), np.float32)
            for j in range(width):
                part = padded[j : j + len(embedded)] @ kernel[j]
                if j:  # a window ends with its text
                    last = bounds[1:][full]
                    for back in range(1, j + 1):
                        inside = last - back >= bounds[:-1][full]
                        part[last[inside] - back] = 0
                answer += part
            answers.append(answer)
            if len(full):
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(answer, bounds[:-1][full], axis=0) + self.biases[k], 0)
        return out, embedded, answers

    def raw(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of each text before calibration, some hundred texts at a time."""
        out = np.zeros(len(bounds) - 1)
        for first in range(0, len(out), 256):
            part = bounds[first : first + 257]
            hidden = self.pooled(words[:, part[0] : part[-1]], part - part[0])[0]
            out[first : first + 256] = hidden @ self.weights + self.bias
        return out

    def language(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The language whose hashed word counts explain each text best; the first where there are no words."""
        sums = np.zeros((words.shape[1] + 1, self.languages.shape[1]))
        np.cumsum(self.languages[words[0]], axis=0, out=sums[1:])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        return total.argmax(1)

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        odds = self.raw(words, bounds) - self.thresholds[self.language(words, bounds)]
        return np.where(odds >= 0, np.maximum(CUT, 1 / (1 + np.exp(-odds - _CUT_ODDS))), np.minimum(np.nextafter(CUT, 0), 1 / (1 + np.exp(-odds - _CUT_ODDS))))


def _words(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many texts, slice by slice."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = [features(data, offsets) for _, _, data, offsets in text_slices(column, TEXT_BYTES)]
    if not parts:
        return np.zeros((1 + len(BEGINNINGS), 0), np.int32), np.zeros(1, np.int64)
    return np.concatenate([w for w, _ in parts], axis=1), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])


def untrained(names: int, seed: int = 1) -> Classifier:
    rng = np.random.default_rng(seed)
    return Classifier(
        (rng.standard_normal((BUCKETS, DIM)) * _SCALE).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * _SCALE * 3).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        (rng.standard_normal(len(WIDTHS) * FILTERS) * _SCALE * 3).astype(np.float32), -1.0,
        np.zeros((BUCKETS, max(1, names))), np.zeros(max(1, names)),
    )


def train(model: Classifier, words: np.ndarray, bounds: np.ndarray, positive: np.ndarray, weight: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Mini-batch Adam on texts, which ``model`` keeps the result of; the buckets whose embedding moved."""
    rng = np.random.default_rng(seed)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return np.zeros(0, np.int64)
    params = [model.embedding, *model.filters, *model.biases, model.weights]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    batches = max(1, len(full) // BATCH)
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(full), batches):
            step += 1
            lengths = bounds[batch + 1] - bounds[batch]
            place = ranges(bounds[batch], lengths)
            kept = rng.random(len(place)) >= DROPPED
            kept[np.cumsum(lengths) - 1] = True  # no text is left without words
            chosen = words[:, place[kept]]
            lengths = np.add.reduceat(kept.astype(np.int64), np.cumsum(lengths) - lengths)
            at = np.concatenate([[0], np.cumsum(lengths)])
            hidden, embedded, answers = model.pooled(chosen, at)
            p = 1 / (1 + np.exp(-(hidden @ model.weights + model.bias)))
            slope = ((p - positive[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads = [np.zeros_like(x) for x in params[1:]]
            grads[-1] += hidden.T @ slope
            back = slope[:, None] * model.weights * (hidden > 0)
            moved, moves = [], []
            for k, (width, kernel) in enumerate(zip(WIDTHS, model.filters)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                answer = answers[k]
                pick = np.stack([a + answer[a:b].argmax(0) for a, b in zip(at, at[1:])])  # the first place of the largest answer
                grads[len(WIDTHS) + k] += part.sum(0)
                for j in range(width):
                    where = pick + j
                    valid = where < at[1:][:, None]
                    flat = np.minimum(where, len(embedded) - 1)
                    signal = part * valid
                    for f in range(FILTERS):
                        grads[k][j][:, f] += embedded[flat[:, f]].T @ signal[:, f]
                        moved.append(flat[:, f])
                        moves.append(signal[:, f : f + 1] * kernel[j][:, f])
            _adam(model, params, moments, grads, chosen, np.concatenate(moved), np.concatenate(moves), step)
            model.bias -= 0.01 * float(slope.sum())
    return np.flatnonzero(moments[0][1].any(1))


def _adam(model, params, moments, grads, chosen, moved, moves, step, rate=0.01):
    """One step; of the embedding only the rows that a largest answer came from."""
    scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for p, (m, v), g in zip(params[1:], moments[1:], grads):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= scale * m / (np.sqrt(v) + 1e-8)
    rows = chosen[:, moved].ravel()
    touched, inverse = np.unique(rows, return_inverse=True)
    g = np.zeros((len(touched), DIM), np.float32)
    np.add.at(g, inverse, np.tile(moves, (len(chosen), 1)))
    m, v = moments[0]
    m[touched] += 0.1 * (g - m[touched])
    v[touched] += 0.001 * (g * g - v[touched])
    params[0][touched] -= scale * m[touched] / (np.sqrt(v[touched]) + 1e-8)


def _threshold(at: np.ndarray, positive: np.ndarray, others: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the best F1, of counts at ascending log odds."""
    above = positive.sum() - np.cumsum(positive)  # positives kept when cutting after i
    kept = (positive + others).sum() - np.cumsum(positive + others)
    f1 = 2 * above[:-1] / np.maximum(1, kept[:-1] + positive.sum())
    if not len(f1) or f1.max() == 0:
        return 0.0
    best = np.flatnonzero(f1 == f1.max())
    i = best[np.argmax(at[best + 1] - at[best])]
    return float((at[i] + at[i + 1]) / 2)


_WIDE = [f"v{i}" for i in range(DIM)]


def _packed(model: Classifier) -> np.ndarray:
    """All parameters in rows of DIM numbers, those of the embedding first."""
    rest = np.concatenate([*[x.ravel() for x in (*model.filters, *model.biases, model.weights)], [model.bias]])
    return np.concatenate([model.embedding, np.append(rest, np.zeros(-len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float64)


def _unpacked(model: Classifier, packed: np.ndarray) -> None:
    model.embedding[:] = packed[:BUCKETS]
    rest, at = packed[BUCKETS:].ravel(), 0
    for x in (*model.filters, *model.biases, model.weights):
        x[...] = rest[at : at + x.size].reshape(x.shape)
        at += x.size
    model.bias = float(rest[at])


def _averaged(spark: SparkSession, dealt: DataFrame, model: Classifier, passes: int, weights: tuple[float, float], turn: int) -> None:
    """One round: every part trains a copy of ``model``, which becomes the mean of what the parts moved."""
    shared, count = spark.sparkContext.broadcast(model), len(_packed(model))

    def trained(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = copy.deepcopy(shared.value)
        table = pa.Table.from_batches(batches)
        words, bounds = _words(table["__text"])
        positive = table["__toxic"].combine_chunks().to_numpy(zero_copy_only=False)
        moved = train(own, words, bounds, positive, np.where(positive, *weights), passes, turn * 1_000_003 + table["__part"][0].as_py())
        rows = np.concatenate([moved, np.arange(BUCKETS, count)]) if len(moved) else moved
        values = np.rint(_packed(own)[rows] * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *map(pa.array, np.ascontiguousarray(values.T))], names=["row", *_WIDE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # rows of a part lie together
            number = batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number)) if len(number) else []
            start = 0
            for end in ends:
                piece = batch.slice(start, end - start)
                if held and held[0].column(1)[0] != piece.column(1)[0]:
                    yield trained(held)
                    held = []
                held.append(piece)
                start = end
        if held:
            yield trained(held)

    made = dealt.filter("not __held").select("__text", "__part", "__toxic").mapInArrow(trimmed(run), "row int, " + ", ".join(f"{c} long" for c in _WIDE))
    # At most one row per bucket and a few more reach the driver.
    sums = made.groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _WIDE]).toArrow()
    packed = _packed(model)
    packed[sums["row"].to_numpy()] = np.stack([sums[c].to_numpy() for c in _WIDE], axis=1) / UNIT / sums["n"].to_numpy()[:, None]
    _unpacked(model, packed)


def _language_counts(dealt: DataFrame, names: list[str], model: Classifier) -> None:
    """Hashed word counts of each language, of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = _words(batch.column(0))
            own = np.array([names.index(x) for x in batch.column(1).to_pylist()], np.int64)
            found, n = np.unique(np.repeat(own, np.diff(bounds)) * BUCKETS + words[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["place", "n"])

    counts = dealt.select("__text", "__lang").mapInArrow(trimmed(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(len(names) * BUCKETS)
    table[counts["place"].to_numpy()] = counts["n"].to_numpy()
    table = table.reshape(len(names), BUCKETS).T
    model.languages[:] = np.log((table + 0.1) / (table.sum(0) + 0.1 * BUCKETS))


def _calibrated(spark: SparkSession, dealt: DataFrame, model: Classifier) -> None:
    """Thresholds by guessed language from the log odds of all texts kept from training, counted in small steps."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = _words(batch.column(0))
            odds = np.clip(np.rint(shared.value.raw(words, bounds) * BINS), -BOUND * BINS, BOUND * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.language(words, bounds)), pa.array(odds), batch.column(1)], names=["guess", "bin", "toxic"])

    texts = dealt.select("__text", "__toxic").mapInArrow(trimmed(run), "guess long, bin long, toxic boolean")
    counts = texts.groupBy("guess", "bin").agg(F.count_if("toxic").alias("positive"), F.count_if(~F.col("toxic")).alias("others")).toArrow()
    guess, at, positive, others = (counts[c].to_numpy() for c in ("guess", "bin", "positive", "others"))
    for k in range(len(model.thresholds)):
        own = guess == k
        own = own if positive[own].sum() >= 5 else np.ones(len(guess), bool)
        bins, place = np.unique(at[own], return_inverse=True)
        model.thresholds[k] = _threshold(bins / BINS, np.bincount(place, positive[own], len(bins)), np.bincount(place, others[own], len(bins)))


def _dealt(texts: DataFrame, marked: DataFrame, parts: int, kept: bool) -> DataFrame:
    """Labelled texts, part by part: texts travel once, to their part, and meet their labels there."""
    part = {"__part": F.pmod(F.xxhash64("__key"), F.lit(parts)).cast("int")}
    apart = F.lit(kept) & (F.pmod(F.xxhash64("__key", F.lit("kept")), F.lit(CALIBRATION)) == 0)

    def labelled(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["__key"].to_pylist(), zip(right["__toxic"].to_pylist(), right["__held"].to_pylist())))
        found = [known.get(k) for k in left["__key"].to_pylist()]
        left = left.filter(pa.array([x is not None for x in found], pa.bool_())).combine_chunks()
        columns = [pa.array([x[i] for x in found if x is not None], pa.bool_()) for i in (0, 1)]
        return left.append_column("__toxic", columns[0]).append_column("__held", columns[1]).sort_by([("__key", "ascending"), ("__text", "ascending")])

    groups = texts.withColumns(part).groupBy("__part").cogroup(marked.withColumns({"__held": apart}).withColumns(part).groupBy("__part"))
    return groups.applyInArrow(labelled, "__key string, __text string, __lang string, __part int, __toxic boolean, __held boolean")


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str = "lang") -> Classifier:
    """Fit on the whole texts of all labelled rows.

    Rows are dealt by a hash of their key into parts of about PART_BYTES. In each of ROUNDS rounds every part
    trains a copy of the model, and the copies are averaged: a row of the embedding over the parts that moved
    it. What reaches the driver is of the model's size. Language counts come from all labelled rows, thresholds from
    all that are kept from training. A key is toxic where any of its labels is; null labels are left out; a null text
    is empty, a null language is a language of its own.
    """
    spark = docs.sparkSession
    marked = labels.groupBy(key).agg(F.max(F.col(label) > 0).alias("__toxic")).filter(F.col("__toxic").isNotNull() & F.col(key).isNotNull())
    sized = docs.select(key, F.coalesce(lang, F.lit("")).alias("__lang"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    totals = sized.join(marked, key).groupBy("__lang", "__toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()  # no text is shuffled
    names = sorted({r["__lang"] for r in totals})
    model, rows = untrained(len(names)), sum(r["rows"] for r in totals)
    positive = sum(r["rows"] for r in totals if r["__toxic"])
    if positive in (0, rows):
        model.weights[:] = 0
        model.bias = 8.0 if positive else -8.0
        return model
    size = sum(r["n"] for r in totals)
    parts = -(-size // PART_BYTES) or 1
    kept = min(positive, rows - positive) >= LEAST_HELD
    dealt = _dealt(docs.select(F.col(key).cast("string").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.coalesce(F.col(lang), F.lit("")).alias("__lang")),
                   marked.select(F.col(key).cast("string").alias("__key"), "__toxic"), int(parts), kept).persist(StorageLevel.MEMORY_AND_DISK)
    rounds = ROUNDS if parts > 1 else 1
    batches = max(1, rows // parts // BATCH)
    passes = max(-(-EPOCHS // rounds), min(-(-LEAST_STEPS // (rounds * batches)), MOST_BYTES * parts // (rounds * max(1, size))))
    for turn in range(rounds):
        _averaged(spark, dealt, model, passes, (rows / positive / 2, rows / (rows - positive) / 2), turn)
    _language_counts(dealt, names, model)
    _calibrated(spark, dealt.filter("__held") if kept else dealt, model)
    dealt.unpersist()
    return model


def score(spark: SparkSession, docs: DataFrame, model: Classifier, *, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every row's whole text; null and empty texts have one too.

    All other columns stay; one named ``column`` is replaced. The model is a few MB of
    arrays of fixed size, broadcast once.
    """
    docs = docs.drop(column)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, _, _ in text_slices(batch.column(place), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(*_words(part.column(place))))], names=[*part.schema.names, column])

    return docs.mapInArrow(trimmed(run), extended(docs.schema, f"`{column}` double"))


def held_out(key: str = "doc_id"):
    return crc(F.col(key)) % 3 == 1
