"""Language masks and the toxicity classifier: held-out accuracy and awkward rows."""

import random

import pytest
from llm_cases import SCHEMA, crc, prose, table
from pyspark.sql import functions as F

from candlewick.llm import language_masks, toxicity

NORTH = "skog fjell vann himmel vinter snø natt dag lys mørke hav øy båt fisk".split()
SOUTH = "bosque montaña agua cielo invierno nieve noche día luz mar isla barco".split()


@pytest.fixture(scope="module")
def talk():
    rng, made = random.Random(3), []
    for i in range(240):
        words, lang = ((NORTH, "no"), (SOUTH, "es"))[i % 2]
        made.append((i, prose(rng, rng.randint(4, 60), words), lang if i % 17 else None, f"src{i % 2}", 0))
    return made


def test_languages(spark, talk):
    docs = spark.createDataFrame(talk, SCHEMA)
    model = language_masks.learn(docs.filter(~language_masks.held_out()))
    got = language_masks.identify(spark, docs.withColumn("score", F.lit("mine")), model).collect()
    assert sorted(model.names) == ["es", "no"] and len(got) == 240
    wrong = [r for r in got if r.lang_pred != ("no" if r.doc_id % 2 == 0 else "es")]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in language_masks.identify(spark, table(spark), model).collect()}
    assert odd[10] == odd[11] == odd[12] == "und" and odd[13] != "und" and len(odd) == 23


def test_untrained_language(spark):
    model = language_masks.learn(table(spark, []))
    assert {r.lang_pred for r in language_masks.identify(spark, table(spark), model).collect()} == {"und"}
    assert language_masks.identify(spark, table(spark, []), model).count() == 0


def test_masks_hold_every_learned_ngram(talk):
    model = language_masks.fill({"no": [t[1] for t in talk[::2]], "es": [t[1] for t in talk[1::2]]})
    import pyarrow as pa

    from candlewick.llm.common import text_slices

    for _, _, data, offsets in text_slices(pa.array([" ".join(NORTH)])):
        hashes, bounds = language_masks.ngrams(data, offsets)
    assert bounds.tolist() == [0, len(hashes)]
    assert (model.containing(hashes) & 2 > 0).mean() > 0.95  # "no" is the second name


def test_toxicity(spark, talk):
    rng = random.Random(9)
    bad, made, labels = ["vileword", "nastyone", "foulterm"], [], []
    for doc, text, lang, source, _ in talk:
        toxic = rng.random() < 0.3
        words = text.split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        made.append((doc, " ".join(words), lang, source, 0))
        labels.append((doc, int(toxic)))
    docs = spark.createDataFrame(made, SCHEMA)
    marks = spark.createDataFrame([*labels, labels[0], (9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks.filter(~toxicity.held_out()))
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs.withColumn("score", F.lit("mine")), model).collect()}
    apart = [(d, y) for d, y in labels if crc(d) % 3 == 1]
    assert sum((got[d] >= toxicity.CUT) == bool(y) for d, y in apart) >= 0.95 * len(apart)
    odd = toxicity.score(spark, table(spark, extra=True), model).collect()
    assert len(odd) == len(table(spark).collect()) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_without_labels(spark):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(table(spark), nothing)
    assert all(r.score < toxicity.CUT for r in toxicity.score(spark, table(spark), model).collect())
    assert toxicity.score(spark, table(spark, []), model).count() == 0
