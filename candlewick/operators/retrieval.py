"""Exact cosine top-k over stored vectors, and what is built from the hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from candlewick.functions.text import EXCERPT_CHARS, preview

# Rows of one tile of the distance matrix: queries by vectors.
TILE = (256, 4096)
# Distances are compared at this precision, so copies tie and ids decide.
DISTANCE_DIGITS = 12

# Fixed value: text shown when nothing was retrieved.
NO_EXCERPTS = "(no excerpts)"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)


def _best_of_blocks(queries: pa.Table, vectors: pa.Table, id_col: str, k: int) -> pa.Table:
    """The ``k`` nearest vectors of one vector block for every query of one query block."""
    dim = len(queries.column("embedding")[0])
    units = _unit(_matrix(queries.column("embedding"), dim))
    ids = vectors.column(id_col).to_numpy()
    stored = _unit(_matrix(vectors.column("embedding"), dim))
    kept = pd.DataFrame({"q": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), id_col: ids[:0], "distance": np.zeros(0)})
    for first in range(0, len(stored), TILE[1]):
        tile = stored[first : first + TILE[1]]
        for low in range(0, len(units), TILE[0]):
            distance = np.round(1.0 - units[low : low + TILE[0]] @ tile.T, DISTANCE_DIGITS)
            last = min(k, distance.shape[1]) - 1
            limit = np.partition(distance, last, axis=1)[:, last]
            q, v = np.nonzero(distance <= limit[:, None])
            found = pd.DataFrame({"q": q + low, "v": v + first, id_col: ids[v + first], "distance": distance[q, v]})
            kept = pd.concat([kept, found], ignore_index=True) if len(kept) else found
        kept = kept.sort_values(["q", "distance", id_col]).groupby("q").head(k)
    return pa.table({
        "query_id": queries.column("query_id").take(pa.array(kept["q"].to_numpy())),
        id_col: vectors.column(id_col).take(pa.array(kept["v"].to_numpy())),
        "distance": pa.array(kept["distance"].to_numpy()),
    })


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def dimension_rejects(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors that no query can be compared with, and why."""
    asked = queries.select(F.size("embedding").alias("_dim")).distinct()
    sized = vectors.withColumn("_dim", F.coalesce(F.size("embedding"), F.lit(0)))
    odd = sized.join(asked, "_dim", "left_anti")
    return odd.withColumn("reason", F.when(F.col("_dim") <= 0, "no embedding").otherwise("no query has this length")).drop("_dim")


def cosine_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "id", group_col: str | None = None,
    query_blocks: int = 1, vector_blocks: int | None = None,
) -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine distance, ties by id.

    ``queries``: query_id, embedding and, with ``group_col``, the value a hit must
    share (a source filter), which is joined on and not masked afterwards. Queries are
    compared with vectors of their own length only (``dimension_rejects`` has the
    others). Every pair of a query block and a vector block is one task that returns k
    rows a query; its memory is that of the two blocks and one tile. Nothing is read
    while the plan is built. ``vector_blocks`` is the session's shuffle partitions
    unless given; raise ``query_blocks`` where all queries don't fit a task.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    blocks = vector_blocks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = ["_dim", *([group_col] if group_col else [])]
    keys = [*shared, "_qb", "_vb"]
    asked = queries.filter(F.size("embedding") > 0).select(
        "query_id", "embedding", *([group_col] if group_col else []), F.size("embedding").alias("_dim"),
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("_qb"), F.explode(_numbers(blocks)).alias("_vb"),
    )
    stored = vectors.filter(F.size("embedding") > 0).select(
        id_col, "embedding", *([group_col] if group_col else []), F.size("embedding").alias("_dim"),
        F.explode(_numbers(query_blocks)).alias("_qb"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("_vb"),
    )
    schema = StructType([queries.schema["query_id"], vectors.schema[id_col], StructField("distance", DoubleType())])
    empty = pa.Table.from_batches([], to_arrow_schema(schema))

    def pair(asked_rows: pa.Table, stored_rows: pa.Table) -> pa.Table:
        if not asked_rows.num_rows or not stored_rows.num_rows:
            return empty
        return _best_of_blocks(asked_rows, stored_rows, id_col, k)

    hits = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(pair, schema)
    nearest = Window.partitionBy("query_id").orderBy("distance", id_col)
    return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def with_chunks(hits: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach text and metadata to hits; a missing source reads ``unknown``."""
    joined = hits.join(chunks, id_col, "left")
    return joined.withColumn("source", F.coalesce("source", F.lit("unknown")))


def knowledge_records(hits: DataFrame) -> DataFrame:
    """What a retrieval hands on per hit: source (``unknown`` when missing), chunk_index, page, chunk_type, title, distance and the text.

    Numbers that are stored as text are read as such; what is none is null.
    """
    whole = lambda c: F.col(c).cast("string").try_cast("bigint") if c in hits.columns else F.lit(None).cast("bigint")
    words = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit(None).cast("string")
    return hits.select(
        "query_id", "rank", F.coalesce(words("source"), F.lit("unknown")).alias("source"), whole("chunk_index").alias("chunk_index"),
        whole("page").alias("page"), words("chunk_type").alias("chunk_type"), words("title").alias("title"), F.col("distance").cast("double").alias("distance"), "text",
    )


def numbered_context(hits: DataFrame, header: Column | None = None) -> DataFrame:
    """Per query, ``[1] text`` blocks in rank order separated by blank lines."""
    body = F.col("text") if header is None else F.concat(header, F.lit("\n"), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("rank", body.alias("body"))))
    grouped = hits.groupBy("query_id").agg(lines.alias("_l"))
    blocks = F.transform("_l", lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["body"]))
    return grouped.select("query_id", F.array_join(blocks, "\n\n").alias("context"))


def source_header() -> Column:
    """``(source #index)`` of a hit."""
    return F.concat(F.lit("("), F.col("source"), F.lit(" #"), F.col("chunk_index").cast("string"), F.lit(")"))


def source_list(hits: DataFrame) -> DataFrame:
    """Ranked source rows with a short preview; a missing index reads -1."""
    return hits.select(
        "query_id", "rank",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        "distance",
        preview(F.col("text")).alias("preview"),
    )


def excerpt_block(hits: DataFrame, limit: int = 4) -> DataFrame:
    """Per query, the first ``limit`` hits as ``[source #index]`` and up to 800 characters."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT_CHARS)
    block = F.concat(F.lit("["), F.col("source"), F.lit(" #"), F.col("chunk_index").cast("string"), F.lit("]\n"), text)
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= limit, F.struct("rank", block.alias("body")))))
    joined = F.array_join(F.transform(kept, lambda e: e["body"]), "\n\n")
    return hits.groupBy("query_id").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_EXCERPTS)).alias("excerpts"))


def citations(hits: DataFrame) -> DataFrame:
    """Hits with both source and index, as citation structs."""
    return hits.filter(F.col("source").isNotNull() & F.col("chunk_index").isNotNull()).select(
        "query_id", "rank", F.struct("source", "chunk_index", "distance").alias("citation")
    )
