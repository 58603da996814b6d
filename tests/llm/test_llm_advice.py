"""Shares of the work a single task gets, and results on groups that are large for their blocks."""

import random
from collections import Counter

import numpy as np
from llm_cases import brute_components, prose, table
from pyspark.sql import functions as F

from candlewick.llm import lsh_forest, suffix_dedup


def test_counting_parts_are_even():
    data = np.random.default_rng(1).integers(97, 123, 1_000_000).astype(np.uint8)
    anchors = np.unique(suffix_dedup.anchor_places(data, np.array([0, len(data)]), 200, 40))
    for parts in (64, 128):
        sizes = np.bincount(suffix_dedup.anchor_parts(anchors, parts), minlength=parts)
        assert len(sizes) == parts
        assert sizes.max() < 1.5 * len(anchors) / parts  # the largest part


def test_copies_of_a_passage_are_few_segments(spark):
    rng = random.Random(2)
    hot = prose(rng, 150)
    made = [(i, hot if i % 3 == 0 else prose(rng, 20), None, None, None) for i in range(900)]
    docs = table(spark, made).select(F.col("text").alias("__text"), F.col("doc_id").alias("__key"), F.xxhash64("text").alias("__hash"))
    wanted = spark.sparkContext.broadcast(suffix_dedup.repeated_anchors(docs, 200, 40))
    got = suffix_dedup.distinct_segments(docs.repartition(4), wanted, 200, 40).collect()
    pieces = Counter(bytes(r.piece) for r in got)
    assert pieces and max(pieces.values()) <= 4  # one row a task, not one for every copy
    assert all(r.times == 2 for r in got if hot.encode().count(bytes(r.piece)))
    runs = {r["__key"]: r["__runs"] for r in suffix_dedup.removal_runs(docs, 200, 40, 1 << 20).collect()}
    assert set(runs) >= {i for i in range(0, 900, 3)}
    assert all(suffix_dedup.merged_runs(runs[i]) == [(0, len(hot))] for i in range(0, 900, 3))


def test_linked_blocks_are_not_paired(spark):
    rng = random.Random(5)
    base, other = prose(rng, 60).split(), prose(rng, 60).split()
    made = [(i, " ".join([*base[:i % 60], f"w{i}", *base[i % 60 + 1 :]]), None, None, None) for i in range(120)]
    made += [(200 + i, " ".join([*other[:30 + 3 * (i % 9)], *(f"v{i}x{j}" for j in range(i % 4))]), None, None, None) for i in range(40)]
    summary = lsh_forest.summaries(table(spark, made), 3, text="text", key="doc_id")
    members = summary.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("component"), "n_shingles")
    links = lsh_forest.exact_links(members, table(spark, made), 3, 80, text="text", key="doc_id", block=16)
    got = {r.id: r.component for r in lsh_forest.components(links).collect()}
    want = brute_components(made, 3, 80)
    assert {d: got.get(d, d) for d in want} == {d: c for d, (_, c, _) in want.items()}
    label = spark.createDataFrame([(d, c) for d, (_, c, _) in want.items()], "id long, label long")
    labelled = members.join(label, "id").select("id", F.col("component").alias("cluster"), "n_shingles", "label")
    dealt = Counter(r.id for r in lsh_forest.open_pairs(labelled, 80, 16).collect())
    assert sum(dealt.values()) < len(made) * -(-len(made) // 16) / 2  # every pair of blocks would be all of it
