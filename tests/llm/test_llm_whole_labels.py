"""The toxicity model comes from all labelled rows, whatever their number and length."""

import random

from llm_cases import SCHEMA, prose

from candlewick.llm import toxicity


def test_long_texts_are_learned_from(spark):
    """All toxic texts are long: before, texts of more than 192 kB were left out."""
    rng = random.Random(5)
    long = lambda bad: " ".join(prose(rng, 40) + (" vileword" if bad else " kindword") for _ in range(900))
    made = [(i, long(i % 3 == 0), "en", "s", 0) for i in range(18)]
    docs = spark.createDataFrame(made, SCHEMA).repartition(4)
    assert min(len(t[1]) for t in made) > 12 << 14
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(18)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= toxicity.CUT for r in toxicity.score(spark, docs, model).collect()}
    assert got == {i: i % 3 == 0 for i in range(18)}


def test_every_part_takes_part(spark, monkeypatch):
    """Many small parts: their averaged copies know a word that few parts saw, and the counts are those of all texts."""
    monkeypatch.setattr(toxicity, "PART_BYTES", 8_000)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 80)
    rng = random.Random(6)
    made, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        made.append((i, prose(rng, 20) + ((" vileword" if i % 40 else " rareword") if bad else ""), ("en", "de")[i % 2], "s", 0))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(made, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: r.score >= toxicity.CUT for r in toxicity.score(spark, docs, model).collect()}
    assert sum(got[i] == bool(y) for i, y in labels) >= 390
    again = toxicity.learn(docs.repartition(5), marks)
    assert (again.embedding == model.embedding).all() and (again.thresholds == model.thresholds).all()
