"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlewick.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); the component is the smallest id that can be reached.

    In every round a node takes the smallest id among itself and its neighbours, and then what that one took.
    Links are then drawn between what their ends took, and those that have become loops or copies are gone, so that a
    group of any size is dealt with once; the rounds grow with the logarithm of the longest chain. What rounds took is
    followed back at the end. Each round is written to the shared folder; the driver reads whether links are left.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    taken: list[DataFrame] = []
    edges = stored(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("near")), "near")
        beyond = near.select(F.col("id").alias("near"), F.col("near").alias("component"))
        labels = stored(near.join(beyond, "near").select("id", "component"), "labels")
        taken.append(labels)
        left, right = (labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_label")) for end in "ab")
        drawn = edges.join(left, "a").join(right, "b").filter("a_label <> b_label")
        edges = stored(drawn.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct(), "links")
        if edges.isEmpty():
            break
    found = taken.pop()
    while taken:
        above = found.select(F.col("id").alias("component"), F.col("component").alias("above"))
        found = taken.pop().join(above, "component", "left").select("id", F.coalesce("above", "component").alias("component"))
    return found
