"""Masks are counted as languages one by one are; texts are read once to be measured and do not come back."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from candlewick.llm import language_masks
from candlewick.llm.common import text_slices
from tests.llm.llm_cases import SCHEMA, prose

WORDS = "skog fjell vann himmel snø natt dag lys hav båt".split()


def test_ngrams_equal_slices_of_each_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aBz .1ø") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    want = []
    for text in texts:
        seen = [b if b >= 128 or chr(b).isalpha() else 0 for b in text.lower().encode()]
        runs = [b for i, b in enumerate(seen) if b or not i or seen[i - 1]]
        runs = (runs[1:] if runs and not runs[0] else runs) + [0]
        grams = {n: [runs[i : i + n] for i in range(len(runs) - n + 1)] for n in language_masks.SIZES}
        want.append([sum(all(g[1:-1]) and any(g) and (n > 2 or g[0] > 0) for g in gs) for n, gs in grams.items()])
    for _, _, data, offsets in text_slices(pa.array(texts)):
        found = language_masks.sized_ngrams(data, offsets)
    assert np.array([np.diff(bounds) for _, bounds in found]).T.tolist() == want


def test_hits_count_every_language():
    """Eleven languages take two groups of mask bits."""
    rng = random.Random(5)
    model = language_masks.fill({f"l{k:02}": [" ".join(rng.choice(WORDS) + "abcdefghijk"[k] for _ in range(40))] for k in range(11)})
    for _, _, data, offsets in text_slices(pa.array(["skoga", "", "vannk natt", "xq"])):
        for hashes, bounds in language_masks.sized_ngrams(data, offsets):
            masks = model.containing(hashes)
            want = [[int((masks[a:b] >> k & 1).sum()) for k in range(11)] for a, b in zip(bounds, bounds[1:])]
            assert model.hits(hashes, bounds).tolist() == want


def test_texts_stay_away(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 8, WORDS), "no" if i % 2 else "nn", "s", 0) for i in range(60)], SCHEMA)
    told, sample = [], language_masks.hash_sample
    monkeypatch.setattr(language_masks, "hash_sample", lambda df, narrow, *a, **b: told.append(narrow) or sample(df, narrow, *a, **b))
    model = language_masks.learn(docs)
    assert model.names == ["nn", "no"] and [d.columns for d in told] == [["__lang", "h", "n"]] * 2
    whole = language_masks.identify(spark, docs, model)
    bare = language_masks.identify(spark, docs, model, keep_text=False)
    assert bare.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, whole.drop("text").collect()))
    assert whole.filter(F.col("text").isNull()).isEmpty()
