"""Near copies by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal sets are one class from the start. Every class enters several
trees: orders of the classes by different runs of its signature. Neighbours in a tree
share a prefix; all that share the first ``DEPTH`` values are a region. A region that
fits one block is thinned by leaders: members are candidates of each other only through
a leader that both resemble. A region that doesn't fit is held together by its first
member as a whole, no greater depth is read: no candidate is lost, true copies or not.
Candidate clusters are then compared exactly, set against set, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from candlewick.llm.common import buffers, may_contain, membership, mixed, ranges, stored, text_hashes, text_slices, trimmed
from candlewick.llm.components import components

TREES, DEPTH = 21, 3
HASHES = TREES * DEPTH
#: Members of a region or cluster that one block holds.
BLOCK = 1024
#: A member joins a leader from this estimate on; it is a candidate of one from the lower estimate on, which
#: leaves room for the triangle inequality (0.2 less) and for the error of HASHES samples.
LEADER, CANDIDATE = 0.8, 0.38
#: Bytes of text turned into sets at a time, so that arrays stay in a core's cache.
TEXT_BYTES = 256 << 10
_SHINGLE = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _multipliers() -> np.ndarray:
    return mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, offsets of the texts in words) of runs of bytes that aren't white; texts don't touch."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~white[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[1:-1][cuts]
    end[cuts - 1] |= inside[1:-1][cuts - 1]
    begins = np.flatnonzero(begin)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, offsets by text)."""
    begins, ends, bounds = word_spans(data, offsets)
    hashes = text_hashes(_LOWER[data], begins, ends)
    sizes = np.diff(bounds)
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - words + 1))
    at = ranges(bounds[:-1], counts)
    owner = np.repeat(np.arange(len(sizes)), counts)
    value = np.zeros(len(at), np.uint64)
    for j in range(words):
        there = at + j < bounds[1:][owner]
        value += np.where(there, hashes[np.minimum(at + j, max(0, len(hashes) - 1))] if len(hashes) else 0, np.uint64(j + 1)) * _SHINGLE[j % 5] ** np.uint64(1 + j // 5)
    value = mixed(value)
    ends = np.cumsum(counts)
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        value[start:end].sort()
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima; texts with an empty set have zeros."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        for j, multiplier in enumerate(_multipliers()):
            out[full, j] = np.minimum.reduceat(sets * multiplier, bounds[:-1][full])
    return (out >> np.uint64(32)).astype(np.uint32)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per run of 64-bit numbers."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def summaries(docs: DataFrame, words: int, *, text: str, key: str) -> DataFrame:
    """key, n_shingles, two halves of the set's digest, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in text_slices(batch.column(1), TEXT_BYTES):
                sets, bounds = shingle_sets(data, offsets, words)
                digests = []
                for salt in (1, 2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets + np.uint64(salt) * _SHINGLE[0]))])
                    digests.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
                columns = [batch.column(0).slice(start, stop - start), pa.array(np.diff(bounds)), *digests, _binary(signatures(sets, bounds))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "d1", "d2", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("__text")).mapInArrow(trimmed(run), f"`{key}` {kind}, n_shingles long, d1 long, d2 long, signature binary")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    data, offsets = buffers(column.cast(pa.large_binary()))
    return data[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def tree_rows(classes: DataFrame) -> DataFrame:
    """(tree, region, id, short) of every class in every tree; ``short`` is the signature in the tree's order, a byte a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _matrix(batch.column(1), np.uint32)
            for tree in range(TREES):
                turned = np.roll(signature, -tree * DEPTH, axis=1)
                region = mixed(turned[:, 0].astype(np.uint64) + (turned[:, 1].astype(np.uint64) << np.uint64(32)))
                region = mixed(region + turned[:, 2].astype(np.uint64) * np.uint64(TREES) + np.uint64(tree))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), batch.column(0), _binary((turned & 255).astype(np.uint8))], names=["region", "id", "short"])

    return classes.select("id", "signature").mapInArrow(trimmed(run), "region long, id long, short binary")


def _leader_links(ids: np.ndarray, short: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one block's candidates: members hang together through leaders they may share a link with."""
    root, open_rows = np.arange(len(ids)), np.arange(len(ids))
    while len(open_rows) > 1:
        leader = open_rows[0]
        alike = (short == short[leader]).mean(axis=1)
        joined = np.unique(root[np.append(np.flatnonzero(alike >= CANDIDATE), leader)])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
        open_rows = open_rows[(alike[open_rows] < LEADER) & (open_rows != leader)]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return [(ids[root[moved]], ids[moved])]


def candidate_links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that hold every region's possible near copies together."""

    def region_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions come whole and in sorted order; blocks and regions may span Arrow batches."""
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        first: tuple[int, int] | None = None  # of the region whose earlier blocks are done: region, first member

        def flush(region, ids, short, last: bool):
            """Links of all complete blocks, and what is kept for the next batch."""
            nonlocal first
            links = []
            edges = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
            kept = len(region)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                open_end = high == len(region) and not last
                if open_end and high - low < block:
                    kept = low
                    break
                hub = first[1] if first and first[0] == region[low] else None
                at = low
                while at < high and (high - at >= block or not open_end):
                    stop = min(at + block, high)
                    if hub is not None or stop < high or open_end:
                        hub = ids[low] if hub is None else hub
                        first = (region[low], hub)
                        links.append((np.full(stop - at, hub), ids[at:stop]))
                    else:
                        if stop - at > 1:
                            links.extend(_leader_links(ids[at:stop], short[at:stop]))
                    at = stop
                kept = at
            return links, (region[kept:], ids[kept:], short[kept:])

        def table(links):
            a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in links]) if links else np.zeros(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint8)
            if held is not None:
                parts = tuple(np.concatenate([x, y]) for x, y in zip(held, parts))
            links, held = flush(*parts, last=False)
            yield table(links)
        if held is not None and len(held[0]):
            yield table(flush(*held, last=True)[0])

    dealt = rows.repartition("region").sortWithinPartitions("region", "short", "id")
    return dealt.mapInArrow(trimmed(region_links), "a long, b long").distinct()


def _intersections(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block's sets."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.argsort(sets, kind="stable")
    value, owner = sets[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(value)))
    shared = np.zeros((n, n), np.float32)
    for size in np.unique(counts[(counts > 1) & (counts <= 12)]).tolist():
        group = owner[starts[counts == size][:, None] + np.arange(size)]
        for i in range(size):
            for j in range(i + 1, size):
                shared += np.bincount(group[:, i] * n + group[:, j], minlength=n * n).reshape(n, n).astype(np.float32) if n <= 64 else 0
                if n > 64:
                    np.add.at(shared, (group[:, i], group[:, j]), 1)
    wide = np.flatnonzero(counts > 12)
    for part in np.array_split(wide, -(-len(wide) // 2048)) if len(wide) else []:
        dense = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), counts[part])
        dense[owner[ranges(starts[part], counts[part])], column] = 1
        shared += np.triu(dense @ dense.T, 1)
    return shared


def _linked(ids: np.ndarray, sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links of one block, as links to the smallest id."""
    shared = _intersections(sets, bounds)
    sizes = np.diff(bounds)
    union = sizes[:, None] + sizes[None, :] - shared
    a, b = np.nonzero((100 * shared >= percent * union) & (shared > 0))
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[moved]], ids[moved]


def exact_links(members: DataFrame, docs: DataFrame, words: int, percent: int, *, text: str, key: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all members (id, component, n_shingles) of a cluster whose full sets are near enough.

    A cluster of one block is compared at once. A larger one is compared inside its blocks
    first; representatives of what that linked are compared inside blocks in rounds, while
    rounds merge much. Last, blocks are formed of single components where they are large
    enough, by size, and a pair of blocks is compared unless all its sets are linked
    already or no two of its sizes allow ``percent``.
    """
    given = docs.filter(F.col(key).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(key).cast("long").alias("id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a pair of blocks come together; all of a task's small clusters are compared one by one."""
        held: list[pa.Table] = []

        def done(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            column = table.column("shingles").combine_chunks() if table.num_rows else pa.array([], pa.binary())
            data, offsets = buffers((column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary()))
            found = _linked(table.column("id").to_numpy(), data[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]) // 8, percent)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = pa.table(batch.slice(low, high - low))
                if held and any(held[0].column(i)[0] != part.column(i)[0] for i in (0, 1)):
                    yield done(pa.concat_tables(held))
                    held = []
                held.append(part)
        if held:
            yield done(pa.concat_tables(held))

    def compared(places: DataFrame) -> DataFrame:
        """Exact links inside every (cluster, pair) of ``places`` (id, cluster, pair)."""
        wanted = docs.sparkSession.sparkContext.broadcast(membership(places.select("id"), places.count()))

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sets of the rows that may be members; the join below is the exact test."""
            for batch in batches:
                batch = batch.filter(pa.array(may_contain(wanted.value, batch.column(1).to_numpy())))
                for start, stop, data, offsets in text_slices(batch.column(0), TEXT_BYTES):
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, stop - start), _blobs(*shingle_sets(data, offsets, words))], names=["id", "shingles"])

        sets = given.mapInArrow(trimmed(sets_of), "id long, shingles binary").join(places, "id").select("cluster", "pair", "id", "shingles")
        return sets.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "id").mapInArrow(trimmed(compare), "a long, b long")

    def in_blocks(rows: DataFrame, salt: int) -> DataFrame:
        sized = rows.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
        return rows.join(sized, "cluster").withColumn("pair", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))

    places = stored(in_blocks(members.select("id", F.col("component").alias("cluster"), "n_shingles"), 0), "clusters")
    links = compared(places.select("id", "cluster", "pair"))
    large = places.filter("blocks > 1").select("id", "cluster", "n_shingles")
    before = large.count()
    if not before:
        return links
    links = stored(links, "near")
    for salt in itertools.count(1):
        label = components(links).withColumnRenamed("component", "label")
        labelled = stored(large.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
        heads = labelled.filter("id = label")
        left = heads.count()
        if left > before / 2:
            break
        before = left
        links = stored(links.union(compared(in_blocks(heads, salt).select("id", "cluster", "pair"))), "near")
    return links.union(compared(open_pairs(labelled, percent, block)))


def open_pairs(labelled: DataFrame, percent: int, block: int) -> DataFrame:
    """(id, cluster, pair) of the block pairs that may hold links between components of (id, cluster, n_shingles, label)."""
    whole = labelled.groupBy("cluster", "label").agg((F.count("*") >= block).alias("whole"))
    owned = labelled.join(whole, ["cluster", "label"]).withColumn("owner", F.when(F.col("whole"), F.col("label")))
    owned = owned.withColumn("band", F.floor(F.log("n_shingles") / float(np.log(max(1.05, 100 / percent)))))
    group = F.concat_ws(":", F.coalesce(F.col("owner").cast("string"), F.lit("mixed")), "band")
    owned = owned.select("id", "cluster", "n_shingles", "owner", group.alias("group"))
    sized = owned.groupBy("cluster", "group").agg(F.ceil(F.count("*") / block).alias("blocks"))
    number = F.concat_ws(":", "group", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = stored(owned.join(sized, ["cluster", "group"]).withColumn("block", number).select("id", "cluster", "n_shingles", "owner", "block"), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.first("owner").alias("owner"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    linked = F.coalesce(F.col("x.owner") == F.col("y.owner"), F.lit(False))
    pairs = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & sizes & ~linked)
    both = F.explode(F.array_distinct(F.array("x.block", "y.block")))
    pairs = pairs.select(F.col("x.cluster").alias("cluster"), F.xxhash64("x.block", "y.block").alias("pair"), both.alias("block"))
    return stored(placed.join(pairs, ["cluster", "block"]).select("id", "cluster", "pair"), "pairs")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id, kept of every row.

    Rows with a common share of at least ``percent`` of their shingles (runs of ``words``
    words) are linked; the component's number is its smallest key, and that row is kept.
    A text of fewer words is one shingle; an empty or null one has none and is linked
    with nothing. The key is a long; rows that repeat a key are one document for links.
    A row whose key is null is linked with nothing, has no component and is kept.
    """
    summary = stored(summaries(docs, words, text=text, key=key), "summaries")
    full = summary.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    digest = ["n_shingles", "d1", "d2"]
    classes = full.groupBy(*digest).agg(F.min(F.struct(F.col(key).cast("long").alias("id"), "signature")).alias("least")).select(*digest, "least.*")
    classes = stored(classes, "classes")
    clusters = components(candidate_links(tree_rows(classes)))
    clusters = clusters.join(classes.select("id", "n_shingles"), "id")
    links = exact_links(clusters, docs, words, percent, text=text, key=key)
    # Rows that repeat a key may stand in two classes: they are one document.
    repeats = full.join(classes.select(*digest, "id"), digest).filter(F.col("id") != F.col(key)).select(F.col("id").alias("a"), F.col(key).cast("long").alias("b"))
    found = components(links.union(repeats))
    label = found.select(F.col("id").alias(key), F.col("component").alias("__component"))
    labelled = summary.select(key, "n_shingles").join(label, key, "left")
    component: Column = F.coalesce("__component", key)
    return labelled.select(key, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))
