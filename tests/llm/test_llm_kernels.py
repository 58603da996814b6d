"""Words, first places and shingle sets are those of plain loops; powers of a slice are made once."""

import random

import numpy as np
import pyarrow as pa

from candlewick.llm import common, lsh_forest, toxicity
from candlewick.llm.common import text_slices

TEXTS = ["one two three four five six one two three four five", "", "a", "word " * 30, "naïve Naïve café x2 y"]


def _slice(texts):
    return next((data, offsets) for _, _, data, offsets in text_slices(pa.array(texts)))


def test_words_need_the_powers_of_a_slice_once(monkeypatch):
    made, powers = [], common.powers
    for module in (common, toxicity):
        monkeypatch.setattr(module, "powers", lambda size: made.append(size) or powers(size), raising=False)
    data, offsets = _slice(TEXTS)
    words, bounds = toxicity.features(data, offsets)
    assert made == [len(data) + 1]
    sums = common.prefix_sums(toxicity._LOWER[data])
    assert np.diff(bounds).tolist() == [11, 0, 1, 30, 5]
    first = common.span_hashes(sums, np.array([0]), np.array([3])) % np.uint64(toxicity.BUCKETS)
    assert words[0, 0] == words[0, 6] == first[0]


def test_words_of_a_long_column_equal_those_of_one_slice(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 16)
    parts = toxicity._words(pa.array(TEXTS * 3))
    whole = toxicity.features(*_slice(TEXTS * 3))
    assert all(np.array_equal(a, b) for a, b in zip(parts, whole))


def test_largest_answers_are_those_of_single_texts():
    model = toxicity.untrained(2)
    words, bounds = toxicity.features(*_slice(TEXTS))
    hidden, embedded, _ = model.pooled(words, bounds)
    assert np.array_equal(embedded, model.embedding[words].sum(0))
    for i, text in enumerate(TEXTS):
        assert np.allclose(model.pooled(*toxicity.features(*_slice([text])))[0][0], hidden[i], atol=1e-6)
    before = model.embedding.copy()
    moved = toxicity.train(model, words, bounds, np.array([True, False, False, True, False]), np.ones(5), 2, 1)
    assert len(moved) and set(np.flatnonzero((model.embedding != before).any(1))) <= set(moved) <= set(words.ravel())


def test_shingle_sets_are_sorted_and_distinct():
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    sets, bounds = lsh_forest.shingle_sets(*_slice(texts), 3)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        words = [w.lower() for w in text.split()]
        want = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        assert b - a == len(want) and (np.diff(sets[a:b].astype(object)) > 0).all()
