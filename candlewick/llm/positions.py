"""Gapless positions in the order of a whole table, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.llm.common import stored

#: Copies of one row that are numbered at a time.
COPIES = 4096


def numbered(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Adds ``name`` (0, 1, ... inside each group, in ``order``) and ``<name>_total`` (rows of the group).

    ``df`` is narrow and all its columns can be ordered; ties are broken by all columns, so
    that rows which still tie are equal and interchangeable. Equal rows are counted before
    they travel and expanded again at the end. What is left is dealt into ranges, written
    with its range, and numbered by the rows of earlier ranges plus those before it in its own. The
    groups may be of any size; null is a group like any other.
    """
    every, groups = df.columns, list(groups)
    counted = df.groupBy(*every).agg(F.count("*").alias("__copies"))
    sort = [*[F.col(g).asc_nulls_first() for g in groups], *order, *[F.col(c).asc_nulls_first() for c in every]]
    dealt = stored(counted.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*groups, "__range").agg(F.sum("__copies").alias("__n"))
    ranges = Window.partitionBy(*groups)
    earlier = ranges.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__{g}") for g in groups], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"), F.sum("__n").over(ranges).alias("__total"),
    )
    inside = Window.partitionBy(*groups, "__range").orderBy(*sort[len(groups) :]).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__before", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = placed.join(offsets, same).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1, F.lit(COPIES))))
    copy = F.explode(F.sequence("__chunk", F.least(F.col("__chunk") + COPIES, F.col("__copies")) - 1))
    return joined.withColumn("__copy", copy).select(
        *every, (F.col("__offset") + F.col("__before") + F.col("__copy")).alias(name), F.col("__total").alias(f"{name}_total")
    )
