"""Stored vectors in compact blocks, and exact top-k that skips blocks by the triangle inequality.

Every vector belongs to the nearest of a bounded number of pivots; the vectors of a pivot are a cell,
dealt into blocks of bounded size. Angles obey the triangle inequality: all vectors of
a cell lie between (angle to the pivot) - radius and (angle to the pivot) + radius. The
upper ends of the cells that together hold k vectors bound the k-th angle of a query, and cells whose
lower end is beyond that are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from candlewick.operators.retrieval import _best_of_blocks, _unit

#: Vectors that serve as pivots (a sample by a hash of their id), and bytes of vectors in a block.
PIVOTS, BLOCK_BYTES = 256, 32 << 20
#: Angles this close count as equal: copies tie, and ids decide among them later.
SLACK = 1e-6
NO_DIRECTION = -1  # the cell of vectors of zeros, at a right angle to everything


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(rows) @ pivots.T, -1.0, 1.0))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorBlocks:
    """An index under ``root``: ``vectors`` by (group, cell, part), ``cells`` with counts and radii, ``pivots``.

    ``group`` optionally names a column that a hit must share with its query. All vectors have ``dim`` numbers;
    others are left out (``retrieval.dimension_rejects`` names them).
    """

    def __init__(self, spark: SparkSession, root: str, dim: int, id_col: str = "id", group: str | None = None):
        self.spark, self.root, self.dim, self.id_col, self.group = spark, root.rstrip("/"), dim, id_col, [group] if group else []

    def build(self, vectors: DataFrame, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> VectorBlocks:
        """Write the index: one pass that assigns cells, one exchange that lays blocks."""
        usable = vectors.filter(F.size("embedding") == self.dim).select(self.id_col, *self.group, "embedding")
        # Zeros have no direction, so they are no pivots; the sample is at most ``pivots`` rows.
        turned = usable.filter(F.exists("embedding", lambda x: x != 0))
        turned.orderBy(F.xxhash64(self.id_col), self.id_col).limit(pivots).select("embedding").write.parquet(f"{self.root}/pivots")
        centres, dim, at = self.pivots(), self.dim, len(usable.columns) - 1
        schema = StructType([*usable.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
        names = schema.names

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _rows(batch.column(at), dim)
                angles = _angles(rows, centres) if len(centres) else np.full((len(rows), 1), np.pi / 2)
                cell = angles.argmin(axis=1)
                angle = angles[np.arange(len(rows)), cell]
                still = ~rows.any(axis=1)
                cell[still], angle[still] = NO_DIRECTION, 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=names)

        usable.mapInArrow(assign, schema).write.parquet(f"{self.root}/assigned")
        assigned = self.spark.read.parquet(f"{self.root}/assigned")
        rows = max(1, block_bytes // (8 * self.dim))
        cells = assigned.groupBy(*self.group, "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        cells.withColumn("parts", F.ceil(F.col("n") / rows)).write.parquet(f"{self.root}/cells")
        placed = assigned.join(self.cells().select(*self.group, "cell", "parts"), [*self.group, "cell"])
        part = F.pmod(F.xxhash64(self.id_col), F.col("parts"))
        placed.withColumn("part", part).drop("parts", "angle").repartition(*self.group, "cell", "part").write.partitionBy("cell").parquet(f"{self.root}/vectors")
        return self

    def pivots(self) -> np.ndarray:
        found = [r[0] for r in self.spark.read.parquet(f"{self.root}/pivots").collect()]
        return _unit(np.array(found, np.float64).reshape(-1, self.dim))

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")

    def vectors(self) -> DataFrame:
        """(id, group, embedding, part, cell) of all indexed vectors, partitioned by cell."""
        assigned = self.spark.read.parquet(f"{self.root}/assigned").schema
        schema = StructType([*[f for f in assigned.fields if f.name != "angle"], StructField("part", LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/vectors")

    def bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, group, cell, parts, kept) of every query and cell: whether the cell can hold one of its ``k`` nearest."""
        centres, dim = self.pivots(), self.dim
        asked = queries.filter(F.size("embedding") == self.dim).select("query_id", *self.group, "embedding")
        schema = StructType([*asked.schema.fields[:-1], StructField("cell", IntegerType()), StructField("angle", DoubleType()), StructField("still", IntegerType())])
        arrow = to_arrow_schema(schema)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _rows(batch.column(batch.num_columns - 1), dim)
                angles = np.column_stack([np.full(len(rows), np.pi / 2), _angles(rows, centres)]) if len(centres) else np.full((len(rows), 1), np.pi / 2)
                owner, cell = np.repeat(np.arange(len(rows)), angles.shape[1]), np.tile(np.arange(-1, angles.shape[1] - 1), len(rows))
                still = (~rows.any(axis=1))[owner].astype(np.int32)
                columns = [*[c.take(pa.array(owner)) for c in batch.columns[:-1]], pa.array(cell.astype(np.int32)), pa.array(angles.ravel()), pa.array(still)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        near = asked.mapInArrow(measure, schema).join(self.cells(), [*self.group, "cell"])
        right = F.lit(float(np.pi / 2))
        loose = (F.col("cell") == NO_DIRECTION) | (F.col("still") == 1)  # one of the two has no direction
        near = near.withColumns({
            "low": F.when(loose, right).otherwise(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius"))),
            "high": F.when(loose, right).otherwise(F.least(F.lit(float(np.pi)), F.col("angle") + F.col("radius"))),
        })
        mine = Window.partitionBy("query_id")  # at most one row per pivot
        held = F.sum("n").over(mine.orderBy("high", "cell").rowsBetween(Window.unboundedPreceding, 0))
        limit = F.min(F.when(F.col("held") >= k, F.col("high"))).over(mine)
        kept = F.col("limit").isNull() | (F.col("low") <= F.col("limit") + SLACK)
        return near.withColumn("held", held).withColumn("limit", limit).select("query_id", *self.group, "cell", "parts", kept.alias("kept"))

    def top_k(self, queries: DataFrame, k: int = 5, query_blocks: int = 1) -> DataFrame:
        """``query_id``, id, distance, rank of the ``k`` nearest, ties by id; ``query_id`` is unique.

        A task holds one block of vectors and those of ``query_blocks``-th of the queries that may have
        a neighbour in it, however large the table is.
        """
        if k < 1:
            raise ValueError("k must be >= 1")
        keys, id_col = [*self.group, "cell", "part", "_qb"], self.id_col
        blocks = self.bounds(queries, k).filter("kept").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        asked = blocks.select("query_id", "cell", "part").join(queries.select("query_id", *self.group, "embedding"), "query_id")
        asked = asked.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
        wanted = asked.select(*keys).distinct()
        stored = self.vectors().join(wanted, keys[:-1])
        stored = stored.select(id_col, "embedding", *[F.col(c).alias(c) for c in keys])
        schema = StructType([queries.schema["query_id"], stored.schema[id_col], StructField("distance", DoubleType())])
        empty = pa.Table.from_batches([], to_arrow_schema(schema))

        def pair(asked_rows: pa.Table, stored_rows: pa.Table) -> pa.Table:
            if not asked_rows.num_rows or not stored_rows.num_rows:
                return empty
            return _best_of_blocks(asked_rows, stored_rows, id_col, k)

        hits = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(pair, schema)
        nearest = Window.partitionBy("query_id").orderBy("distance", id_col)
        return hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
