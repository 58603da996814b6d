"""Order-dependent work on long series without one task per series.

Three primitives carry every ordered operator in the package:

* ``index_rows`` numbers the rows of each series. Rows are counted per time
  bucket, the (narrow) counts are turned into offsets by a two-level running
  total, and a window only ever ranks the rows of one bucket.
* ``halo_blocks`` cuts a numbered series into fixed blocks that also carry the
  neighbouring rows a bounded frame needs, so windows partition by
  (series, block) and one hot series spreads over the cluster.
* ``running_offsets`` gives each block what came before it, which turns a
  running total over the whole series into block-local work plus an offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.session import stored_once

FANOUT = 4096
BLOCK = 2048
#: The bucket of rows without a time, before all others.
UNTIMED = -(1 << 40)


def running_offsets(
    totals: DataFrame, keys: Sequence[str], block: str, values: Sequence[str], fanout: int = FANOUT
) -> DataFrame:
    """Add ``<value>_before``: the sum over all earlier blocks of the same series.

    ``totals`` has one row per (keys, block). Sums run inside groups of
    ``fanout`` blocks, then over the groups.
    """
    keys = list(keys)
    grouped = totals.withColumn("_group", F.floor(F.col(block) / fanout))
    inner = Window.partitionBy(*keys, "_group").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy(*keys, "_group").agg(*[F.sum(v).alias(v) for v in values]).select(
        *keys, "_group", *[F.coalesce(F.sum(v).over(outer), F.lit(0)).alias(f"_{v}_outer") for v in values]
    )
    inner_sums = grouped.select(
        "*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_{v}_inner") for v in values]
    )
    joined = inner_sums.join(groups, [*keys, "_group"])
    return joined.select(
        *totals.columns, *[(F.col(f"_{v}_inner") + F.col(f"_{v}_outer")).alias(f"{v}_before") for v in values]
    )


def bucket(ts: str | Column, seconds: int) -> Column:
    """The span of time of a row."""
    return F.coalesce(F.floor(F.unix_seconds(ts) / seconds), F.lit(UNTIMED))


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    ties: Sequence[str] = (),
    bucket_seconds: int = 86_400,
    name: str = "idx",
    times: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each series from 0 in time order.

    Rows must be unique per (keys, ts, ties); rows without a time come first, and none
    is lost. ``df`` is read twice (counts, then ranks), so pass a stored table or a
    persisted frame, or in ``times`` the keys and times of its rows where they cost less than
    ``df``, which is then read once. Choose ``bucket_seconds``
    so that one bucket holds a few thousand rows. A ``_bucket`` that ``df`` is laid out by is taken as it is.
    """
    keys = list(keys)
    bucketed = df if "_bucket" in df.columns else df.withColumn("_bucket", bucket(ts, bucket_seconds))
    counted = bucketed if times is None else times.withColumn("_bucket", bucket(ts, bucket_seconds))
    totals = counted.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    totals = totals.persist() if times is None else stored_once(totals, "bucket-counts")  # read twice, narrow
    offsets = running_offsets(totals, keys, "_bucket", ["_n"]).select(*keys, "_bucket", "_n_before")
    rank = Window.partitionBy(*keys, "_bucket").orderBy(ts, *ties)
    return (
        bucketed.withColumn("_rank", F.row_number().over(rank))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_n_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_n_before")
    )


def halo_blocks(
    df: DataFrame, before: int, after: int = 0, idx: str = "idx", size: int = BLOCK, block: str = "block"
) -> DataFrame:
    """Copy each row into its own block and into every block whose halo holds it.

    Adds ``block`` and ``core`` (true on the row's own block). Work that needs
    ``before`` earlier and ``after`` later rows is exact on core rows when
    windows partition by (keys, block).
    """
    own = F.floor(F.col(idx) / size)
    first = F.greatest(F.lit(0), F.floor((F.col(idx) - after) / size))
    last = F.floor((F.col(idx) + before) / size)
    return df.withColumn(block, F.explode(F.sequence(first, last))).withColumn("core", F.col(block) == own)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by a hash over all shuffle partitions, which are not merged by their size.

    Merged partitions are about as many as cores, and one more; where a row is few bytes and much work,
    the last one then takes as long as all others.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def block_window(keys: Sequence[str], idx: str = "idx", block: str = "block"):
    return Window.partitionBy(*keys, block).orderBy(idx)


def first_index(df: DataFrame, keys: Sequence[str], at: Column, ts: str = "ts", idx: str = "idx") -> DataFrame:
    """Index of the first row at or after ``at`` per series; series without one are absent."""
    return df.filter(F.unix_seconds(ts) >= F.unix_seconds(at)).groupBy(*keys).agg(F.min(idx).alias("start_idx"))


def tiles(df: DataFrame, size: int, idx: str = "idx", stride: int | None = None) -> DataFrame:
    """Windows of ``size`` rows that begin every ``stride`` rows (every ``size`` unless given).

    ``tile`` joins the series key and ``idx`` restarts at 0 in each. With a smaller
    stride windows overlap, so that what spans the seam of two lies inside another.
    """
    step = stride or size
    first = F.greatest(F.lit(0), F.floor((F.col(idx) - size) / step) + 1)
    return df.withColumn("tile", F.explode(F.sequence(first, F.floor(F.col(idx) / step)))).withColumn(idx, F.col(idx) - F.col("tile") * step)
