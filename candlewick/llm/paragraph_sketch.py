"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph is a line; its digest is 64 bits. A document's digests are dealt into
groups by hash, and every group is a small sketch: cells that hold a count, the XOR of
digests and the XOR of their checks. Two sketches subtract cell by cell, and peeling
cells that hold a single digest recovers what only one of the two has. A group that
does not peel to nothing is sketched again with twice the cells; a few that never do
are compared digest by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from candlewick.llm.histogram_shards import range_of

#: Digests a group is meant for, cells of its first sketch, rows a digest falls in, sketches tried.
GROUP = 8
CELLS = 30
WAYS = 3
TRIES = 3
ROUNDS = 8
#: The order of documents is read off in ranges of about so many rows, of which there are at most RANGES.
ROWS_PER_RANGE = 500
RANGES = 512


def _zero() -> Column:
    return F.lit(0).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use)[0]


def digests(text: Column) -> Column:
    """Distinct digests of the lines of a text, ascending; null and empty texts have none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line != "")
    return F.array_sort(F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line))))


def groups_of(count: Column) -> Column:
    """Groups of a document with so many digests: a power of two, so that sketches of like documents align."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(count, F.lit(1)) / GROUP))).cast("int"))


def _cell(digest: Column, way: int, cells: int) -> Column:
    """The cell of a digest in the part of the sketch that belongs to one way."""
    part = cells // WAYS
    return F.pmod(F.shiftright(F.xxhash64(digest, F.lit(cells)), 20 * way), F.lit(part)).cast("int") + part * way


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def signed(digests: Column, sign: int, group: Column, groups: Column) -> Column:
    """(d, s) of the digests of one group."""
    own = F.filter(digests, lambda d: F.pmod(d, groups) == group)
    return F.transform(own, lambda d: F.struct(d.alias("d"), F.lit(sign).cast("long").alias("s")))


def sketch(entries: Column, cells: int) -> Column:
    """Cells (n, k, c) of signed digests: the difference of two sketches when both signs occur."""
    placed = F.transform(
        entries, lambda e: F.struct(e["d"].alias("d"), e["s"].alias("s"), _check(e["d"]).alias("c"), F.array(*[_cell(e["d"], w, cells) for w in range(WAYS)]).alias("at"))
    )
    empty = F.struct(_zero().alias("n"), _zero().alias("k"), _zero().alias("c"))
    part = cells // WAYS
    return F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda i: F.aggregate(
            F.filter(placed, lambda e: F.get(e["at"], F.floor(i / part).cast("int")) == i), empty,
            lambda acc, e: F.struct((acc["n"] + e["s"]).alias("n"), acc["k"].bitwiseXOR(e["d"]).alias("k"), acc["c"].bitwiseXOR(e["c"]).alias("c")),
        ),
    )


def _peel_round(state: Column, cells: int) -> Column:
    """Take all digests that stand alone in a cell out of every cell they fell in."""
    pure = F.array_distinct(
        F.transform(
            F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))), lambda c: F.struct(c["k"].alias("d"), c["n"].alias("s"))
        )
    )

    def without(pure: Column) -> Column:
        left = F.zip_with(
            state["cells"], sketch(pure, cells),
            lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")),
        )
        plus = F.size(F.filter(pure, lambda p: p["s"] > 0))
        return F.struct(left.alias("cells"), (state["plus"] + plus).alias("plus"), (state["minus"] + F.size(pure) - plus).alias("minus"))

    return bound(pure, lambda p: F.when(F.size(p) > 0, without(p)).otherwise(state))


def _peel(entries: Column, cells: int) -> Column:
    """(plus, minus): how many digests only one side has; null where the sketch does not peel to nothing."""
    start = F.struct(sketch(entries, cells).alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda state, _: F.when(F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), _peel_round(state, cells)).otherwise(state),
        lambda state: F.when(~F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), F.struct(state["plus"].alias("plus"), state["minus"].alias("minus"))),
    )
    return end


def differing(one: Column, two: Column) -> Column:
    """(plus, minus) of two digest lists, group by group, retrying with larger sketches."""
    groups = F.greatest(groups_of(F.size(one)), groups_of(F.size(two)))

    def of_group(group: Column) -> Column:
        both = F.concat(signed(one, 1, group, groups), signed(two, -1, group, groups))
        left, right = (F.filter(x, lambda d: F.pmod(d, groups) == group) for x in (one, two))
        exact = F.struct(F.size(F.array_except(left, right)).alias("plus"), F.size(F.array_except(right, left)).alias("minus"))
        return bound(both, lambda entries: F.coalesce(*[_peel(entries, CELLS << k) for k in range(TRIES)], exact))

    each = F.transform(F.sequence(F.lit(0), groups - 1), of_group)
    start = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"))
    return F.aggregate(each, start, lambda a, b: F.struct((a["plus"] + b["plus"]).alias("plus"), (a["minus"] + b["minus"]).alias("minus")))


def likeness(one: Column, two: Column) -> Column:
    """Common digests over all digests of either side, 1 where neither has any."""
    difference = differing(one, two)
    return bound(difference, lambda d: F.when(F.size(one) + d["minus"] > 0, (F.size(one) - d["plus"]) / (F.size(one) + d["minus"])).otherwise(1.0)).cast("double")


def fingerprint(digests: Column) -> Column:
    """The sketch as text: the number of digests, then every group's cells that hold anything, as place.count.digests.checks."""
    groups = groups_of(F.size(digests))

    def of_group(group: Column) -> Column:
        cells = F.transform(
            sketch(signed(digests, 1, group, groups), CELLS), lambda c, i: F.struct(i.alias("i"), c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"))
        )
        held = F.filter(cells, lambda c: c["n"] != 0)
        return F.array_join(F.transform(held, lambda c: F.concat_ws(".", c["i"], c["n"], F.hex(c["k"]), F.substring(F.hex(c["c"]), 1, 8))), " ")

    return F.concat(F.size(digests), F.lit("|"), F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), of_group), "|"))


def with_next(docs: DataFrame, *, text: str = "text", key: str = "doc_id", ranges: int = RANGES) -> DataFrame:
    """``docs`` with next_text, the text of the next row by descending key (nulls last; after the last row the first).

    Rows of one key follow by descending text hash. The numeric key is cut into ranges
    at its quantiles, at most ``ranges`` of them; a row's successor is the next in its
    range or, for the last there, the first of the next range.
    """
    tied = docs.withColumn("__tie", F.xxhash64(text))
    found = tied.agg(F.count("*").alias("n"), F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first()
    step = max(1, ranges * ROWS_PER_RANGE // max(1, found["n"]))
    bounds = sorted(set((found["b"] or [])[::step]))
    place = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - range_of(F.col(key), bounds))
    ranged = tied.withColumn("__range", place)
    order = Window.partitionBy("__range").orderBy(F.col(key).desc_nulls_last(), F.col("__tie").desc())
    inside = ranged.withColumns({"__next": F.lead(F.coalesce(text, F.lit(""))).over(order)})
    content = F.coalesce(text, F.lit(""))
    firsts = ranged.groupBy("__range").agg(F.max_by(content, F.struct(key, "__tie")).alias("__head"))
    around = Window.orderBy("__range")  # over at most a row per range
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("__range", F.coalesce(F.lead("__head").over(around), F.first("__head").over(whole)).alias("__after"))
    joined = inside.join(heads, "__range", "left")
    return joined.select(*docs.columns, F.coalesce("__next", "__after").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many of the next text's first."""
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - half), F.substring(following, F.lit(1), half))


def compared_versions(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints and how like the edited and the next text are.

    A null text is empty and equal to an empty one; an only row is its own successor;
    repeated rows follow each other. Other columns are not read.
    """
    following = with_next(docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("__text")), text="__text", key=key)
    changed = following.withColumn("__edited", edited(F.col("__text"), F.col("next_text")))
    own = changed.select(
        key, F.length("__text").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"),
        digests(F.col("__text")).alias("__own"), digests(F.col("__edited")).alias("__changed"), digests(F.col("next_text")).alias("__following"),
    )
    return own.select(
        key, "n_chars", "edited_sha256", fingerprint(F.col("__own")).alias("fingerprint"), fingerprint(F.col("__changed")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__changed")).alias("near_edited"), likeness(F.col("__own"), F.col("__following")).alias("near_next"),
    )
