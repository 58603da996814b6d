"""Block index against brute force: same rows, fewer blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators.retrieval import DISTANCE_DIGITS
from candlewick.operators.vector_blocks import VectorBlocks

VECTORS = "id long, g string, embedding array<double>"


def brute(vectors, queries, k, grouped):
    out = []
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
    for q, g, e in queries:
        found = sorted((round(1.0 - float(unit(e) @ unit(v)), DISTANCE_DIGITS), i) for i, h, v in vectors if len(v) == len(e) and (not grouped or g == h))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("grouped", [False, True])
def test_same_rows_and_pruned_cells(spark, tmp_path, grouped):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    vectors = [(i, "ab"[i % 2], (centres[i % 12] + rng.normal(size=6) * 0.02).tolist()) for i in range(600)]
    vectors += [(600 + i, "a", vectors[i][2]) for i in range(5)] + [(700, "a", [0.0] * 6), (701, "b", [0.0] * 6), (702, "a", [1.0] * 5)]
    queries = [(i, "ab"[i % 2], (centres[i] + rng.normal(size=6) * 0.01).tolist()) for i in range(8)] + [(90, "a", [0.0] * 6), (91, "b", (-centres[0]).tolist()), (92, "c", centres[0].tolist())]
    index = VectorBlocks(spark, str(tmp_path / "index"), 6, group="g" if grouped else None)
    index.build(spark.createDataFrame(vectors, VECTORS), pivots=40, block_bytes=8 * 6 * 10)
    asked = spark.createDataFrame(queries, VECTORS.replace("id", "query_id", 1))
    got = sorted((r.query_id, r.id, r["rank"]) for r in index.top_k(asked, 7, query_blocks=2).collect())
    assert got == brute(vectors, queries, 7, grouped)
    kept = {r.kept: r["count"] for r in index.bounds(asked.filter("query_id < 8"), 7).groupBy("kept").count().collect()}
    assert kept[False] > 2 * kept[True]
    largest = spark.read.parquet(str(tmp_path / "index/vectors")).groupBy(*index.group, "cell", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 40


def test_no_vectors(spark, tmp_path):
    index = VectorBlocks(spark, str(tmp_path / "index"), 3).build(spark.createDataFrame([(1, None, [1.0, 2.0])], VECTORS))
    assert index.top_k(spark.createDataFrame([(1, None, [1.0, 2.0, 3.0])], VECTORS.replace("id", "query_id", 1)), 2).count() == 0
