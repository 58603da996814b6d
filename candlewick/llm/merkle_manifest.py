"""Merkle manifest of a dataset: every row's proof, from nodes labelled by nested intervals.

A leaf's label is its rank in its tree; a node's is the interval of leaf ranks that it
covers. Labels alone say who contains whom, so that a join on (tree, level, interval
bucket) with a containment condition attaches every ancestor, and an ancestor's members
less the one that holds the leaf are the siblings a proof needs. Trees grow by blocks of
``fanout ** block_levels`` units at a time: a block's levels are folded in one row, its top is a unit of
the next round, and the proof of a leaf is that inside its block followed by its block's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.llm.common import stored
from candlewick.llm.positions import numbered

#: Levels that one round folds; a block has FANOUT ** BLOCK_LEVELS units at most.
FANOUT, BLOCK_LEVELS = 2, 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def tree_label(value: Column) -> Column:
    """A label that is never null and orders like the value, null first, bytewise."""
    return F.coalesce(F.concat(F.lit(":"), value.cast("string")), F.lit("-"))


def _parents(below: Column, fanout: int) -> Column:
    """Digests one level up; a last run may be shorter, even one."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * fanout + 1, F.lit(fanout)), ""), 256))


class Forest:
    """Trees over ``leaves`` (tree, lo, n, digest): ``lo`` counts from 0 in each tree of ``n`` leaves.

    ``rounds[r]`` holds the nodes of levels r * block_levels and up, written to the shared
    folder: tree, n, j (level in the round), lo, hi (leaf ranks), digest, depth (levels of its block).
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS):
        self.fanout, self.levels, self.width = fanout, block_levels, fanout**block_levels
        self.rounds: list[DataFrame] = []
        units, span = leaves.select("tree", "n", "lo", "digest"), 1
        largest = leaves.agg(F.max("n")).first()[0] or 0
        while True:
            self.rounds.append(stored(self._grown(units, span), "nodes"))
            span *= self.width
            if span >= largest:
                return
            units = self.rounds[-1].filter((F.col("j") == self.levels) & (F.col("n") > span)).select("tree", "n", "lo", "digest")

    def _spans(self, span: int) -> Column:
        """Leaf ranks that a node covers, by level in the round."""
        return F.array(*[F.lit(span * self.fanout**j).cast("long") for j in range(self.levels + 2)])

    def _grown(self, units: DataFrame, span: int) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("lo", "digest")))
        blocks = units.groupBy("tree", "n", F.floor(F.col("lo") / (span * self.width)).alias("block")).agg(members["digest"].alias("digests"))
        climbs = F.filter(F.sequence(F.lit(0), F.lit(self.levels - 1)), lambda j: F.element_at(self._spans(span), j + 1) < F.col("n"))
        grown = F.aggregate(climbs, F.array("digests"), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1), self.fanout))))
        rows = blocks.select("tree", "n", "block", F.size(climbs).alias("depth"), F.posexplode(grown).alias("j", "row"))
        nodes = rows.select("tree", "n", "block", "depth", "j", F.posexplode("row").alias("i", "digest"))
        covers = F.element_at(self._spans(span), F.col("j") + 1)
        lo = F.col("block") * (span * self.width) + F.col("i") * covers
        return nodes.select("tree", "n", "j", "depth", lo.alias("lo"), F.least(lo + covers, "n").alias("hi"), "digest")

    def roots(self) -> DataFrame:
        """(tree, digest): the node that covers all leaves of its tree."""
        whole = [r.filter("lo = 0 and hi = n and j = depth").select("tree", "digest", F.lit(k).alias("round")) for k, r in enumerate(self.rounds)]
        found = whole[0]
        for more in whole[1:]:
            found = found.unionByName(more)
        # A block top that covers a whole tree is that tree's only one: later rounds have no node of it.
        return found.select("tree", "digest")

    def _inner(self, nodes: DataFrame, span: int) -> DataFrame:
        """(tree, lo, steps) of a round's units: the siblings up to the top of their block."""
        members = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        spans = self._spans(span)
        above = F.element_at(spans, F.col("j") + 2)
        families = (
            nodes.filter("j < depth").groupBy("tree", F.col("j").alias("level"), F.floor(F.col("lo") / above).alias("bucket"))
            .agg(F.min("lo").alias("from"), F.max("hi").alias("to"), members.alias("members"))
        )
        units = nodes.filter("j = 0 and depth > 0").select("tree", "lo", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level"))
        units = units.withColumn("bucket", F.floor(F.col("lo") / F.element_at(spans, F.col("level") + 2)))
        held = units.join(families, ["tree", "level", "bucket"]).filter("from <= lo and lo < to")
        said = lambda test: F.array_join(F.transform(F.filter("members", test), lambda m: m["digest"]), "")
        step = F.struct("level", said(lambda m: m["hi"] <= F.col("lo")).alias("before"), said(lambda m: m["lo"] > F.col("lo")).alias("after"))
        return held.groupBy("tree", "lo").agg(F.array_sort(F.collect_list(step)).alias("steps"))

    def proofs(self, crown: DataFrame) -> DataFrame:
        """(tree, lo, path and the other columns of ``crown``) of every leaf.

        ``crown``: tree, path (steps above the tree's root) and more columns that every leaf
        of the tree gets; they come down block by block, never by one join on the tree.
        """
        more = [c for c in crown.columns if c not in ("tree", "path")]
        span, found = self.width ** len(self.rounds), None
        for nodes in reversed(self.rounds):
            top = span
            span //= self.width
            units = nodes.filter("j = 0").select("tree", "n", "lo")
            inner = units.join(self._inner(nodes, span), ["tree", "lo"], "left")
            # A tree that ends in this round takes its crown here, other units that of their block.
            ended = inner.filter(F.col("n") <= top).join(crown, "tree")
            if found is not None:
                higher = found.withColumnRenamed("lo", "of")
                below = inner.filter(F.col("n") > top).withColumn("of", F.floor(F.col("lo") / top) * top)
                ended = ended.unionByName(below.join(higher, ["tree", "of"]).drop("of"))
            here = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
            found = ended.select("tree", "lo", F.concat(here, "path").alias("path"), *more)
        return found


#: Type of a path: what stands left and right of a node among its parent's members, level by level.
PATH = "array<struct<before: string, after: string>>"


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(leaves: DataFrame, *, tree: str = "tree", key: str = "key", leaf: str = "leaf", fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Rows of ``leaves`` with ``subroot``, ``root`` and ``path``; columns of these names are replaced.

    One tree for every value of ``tree``, null included, leaves ascending by ``key`` (null
    first); equal keys are ordered by ``leaf`` and the other columns, equal rows are one leaf each. The roots
    of the trees, ordered by ``tree`` (null first, bytewise), are the leaves of the last tree. A single
    leaf is its tree's root and has no siblings there. No rows give no rows. ``leaves`` is
    narrow (no texts): digests and what identifies the row.
    """
    carried = [c for c in leaves.columns if c not in (tree, key, leaf, "subroot", "root", "path")]
    rows = leaves.select(
        tree_label(F.col(tree)).alias("tree"), F.col(key).alias("key"), F.col(leaf).alias("digest"),
        F.struct(F.col(tree).alias("__tree"), *carried).alias("row"),
    )
    ranked = stored(numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest")], ["tree"], "lo").withColumnRenamed("lo_total", "n"), "leaves")
    forest = Forest(ranked, fanout, block_levels)
    subroots = numbered(forest.roots(), [F.col("tree")], name="lo").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "lo", F.col("lo_total").alias("n"), "digest")
    subroots = stored(subroots, "subroots")
    top = Forest(subroots, fanout, block_levels)
    root = top.roots().select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    crown = subroots.select("lo", "of", F.col("digest").alias("subroot")).join(top.proofs(root).drop("tree"), "lo")
    proven = forest.proofs(crown.select(F.col("of").alias("tree"), "path", "subroot", "root"))
    return ranked.join(proven, ["tree", "lo"]).select(
        F.col("row.__tree").alias(tree), F.col("key").alias(key), F.col("digest").alias(leaf), *[F.col("row")[c].alias(c) for c in carried], "subroot", "root", "path"
    )
