"""Annotation rows: levels, lines, runs, markers and outcomes in one narrow schema.

Every builder returns (keys, name, type, t1, p1, t2, p2, text); times are epoch
seconds on the feed clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.numbers import is_true
from candlewick.functions.text import strip
from candlewick.functions.times import feed_seconds
from candlewick.operators.indicators import SMA_PERIODS
from candlewick.operators.series import BLOCK, block_window, halo_blocks
from candlewick.operators.walk import REGIMES, WATCH_INSTABILITY, WATCH_P_HAT, change_watch

# Annotation types, overlay size and display choices.
TYPES = ("trend", "hline", "vline", "text", "arrow", "rectangle", "label")
STYLES = ("solid", "dash", "dot", "dashdot")
SHOW = ("ranges", "markers", "both")
OVERLAY_STRIDE = 2

#: Copies of a series' ends that its points are dealt over.
SALTS = 16

FIELDS = ("name", "type", "t1", "p1", "t2", "p2", "text")


def _item(
    name: Column, kind: str, t1: Column | None = None, p1: Column | None = None, t2: Column | None = None,
    p2: Column | None = None, text: Column | None = None,
) -> Column:
    null = F.lit(None)
    parts = (("t1", t1, "bigint"), ("p1", p1, "double"), ("t2", t2, "bigint"), ("p2", p2, "double"), ("text", text, "string"))
    return F.struct(
        name.alias("name"), F.lit(kind).alias("type"), *[(null if c is None else c).cast(t).alias(n) for n, c, t in parts]
    )


def _explode(df: DataFrame, keys: Sequence[str], *items: Column) -> DataFrame:
    """One row per non-null item."""
    rows = df.select(*keys, F.explode(F.array_compact(F.array(*items))).alias("o"))
    return rows.select(*keys, *[f"o.{f}" for f in FIELDS])


def _named(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _bounded_end(t1: Column, t2: Column) -> Column:
    """An interval is at least one second long."""
    return F.when(t2.isNull() | (t2 == t1), t1 + 1).otherwise(t2)


def polyline(points: DataFrame, keys: Sequence[str], stride: Column | int = OVERLAY_STRIDE, offset: int = 0, block: int = BLOCK) -> DataFrame:
    """Connected segments over every ``stride``-th valued row, always reaching the last one.

    ``points``: keys, idx, ts, value of series of any length; values may be null before the
    first valued row only. A joint's number follows from its distance to the first
    valued row, so that neighbours meet in blocks of joints with one row of halo.
    """
    keys = list(keys)
    step = F.lit(stride) if isinstance(stride, int) else stride
    valued = points.filter(F.col("value").isNotNull())
    ends = valued.groupBy(*keys).agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    salted = ends.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    placed = valued.withColumn("_salt", F.pmod(F.col("idx").cast("bigint"), F.lit(SALTS))).join(salted, [*keys, "_salt"])
    place = F.col("idx") - F.col("_first")
    joints = placed.filter((place % step == 0) | (F.col("idx") == F.col("_last"))).select(
        *keys, F.ceil(place / step).cast("bigint").alias("segment"), "ts", "value"
    )
    w = block_window(keys, idx="segment")
    lines = halo_blocks(joints, before=0, after=1, idx="segment", size=block).withColumns(
        {"_ts": F.lead("ts").over(w), "_value": F.lead("value").over(w)}
    ).filter(F.col("core") & F.col("_ts").isNotNull())
    return lines.select(
        *keys, "segment",
        feed_seconds(F.col("ts"), offset).alias("t1"), F.col("value").alias("p1"),
        feed_seconds(F.col("_ts"), offset).alias("t2"), F.col("_value").alias("p2"),
    )


def overlay_lines(recent: DataFrame, keys: Sequence[str], prefix: str, stride: int = OVERLAY_STRIDE, offset: int = 0) -> DataFrame:
    """Average and band polylines over every ``stride``-th row."""
    names = {f"sma_{p}": f"sma{p}" for p in SMA_PERIODS} | {
        f"bb_{b}": f"bb.{b}" for b in ("upper_2", "upper_1", "lower_1", "lower_2")
    }
    pairs = F.array(*[F.struct(F.lit(label).alias("series"), F.col(c).alias("value")) for c, label in names.items()])
    points = recent.select(*keys, "idx", "ts", F.explode(pairs).alias("s")).select(*keys, "idx", "ts", "s.*")
    lines = polyline(points, [*keys, "series"], stride, offset)
    return lines.select(
        *keys, _named(prefix, F.col("series"), ".", F.col("segment")).alias("name"), F.lit("trend").alias("type"),
        "t1", "p1", "t2", "p2", F.lit(None).cast("string").alias("text"),
    )


def regime_annotations(classified: DataFrame, recent: DataFrame, keys: Sequence[str], prefix: str = "regime.", offset: int = 0) -> DataFrame:
    """Overlay lines of the last bars, recent extremes and the checklist line."""
    trend = F.when(F.col("adx_rising"), "rising").when(F.col("adx_slope").isNotNull(), "falling").otherwise("?")
    label = F.concat(
        F.lit("regime="), F.col("regime"), F.lit(" ADX="), F.coalesce(F.col("adx").cast("string"), F.lit("None")), F.lit(" "), trend,
        F.lit(" perfect_order="), F.coalesce("ma_perfect_order", F.lit("None")),
        F.lit(" plays="), F.array_join("allowed_play_classes", ","),
    )
    flat = _explode(
        classified, keys,
        F.when(F.col("high_n").isNotNull(), _item(F.lit(f"{prefix}high_n"), "hline", p1=F.col("high_n"))),
        F.when(F.col("low_n").isNotNull(), _item(F.lit(f"{prefix}low_n"), "hline", p1=F.col("low_n"))),
        _item(F.lit(f"{prefix}label"), "label", text=label),
    )
    return overlay_lines(recent, keys, prefix, offset=offset).unionByName(flat)


def _lines(n: Column, name: str, line: Column, last_idx: Column, last_ts: Column, offset: int) -> Column:
    """A segment and, when it ends before the last bar, its extension."""
    at = lambda c: feed_seconds(c, offset)
    timed = line["ts0"].isNotNull() & line["ts1"].isNotNull()
    main = _item(n, "trend", at(line["ts0"]), line["price0"], at(line["ts1"]), line["price1"])
    more = _item(_named(n, ".ext"), "trend", at(line["ts1"]), line["price1"], at(last_ts), line["price_at_last"])
    extends = timed & (line["i1"] < last_idx) & last_ts.isNotNull()
    return F.array(F.when(timed, main), F.when(is_true(extends), more))


def formation_annotations(analyses: DataFrame, keys: Sequence[str], prefix: str = "form.", offset: int = 0) -> DataFrame:
    """Swings, trendlines, shoulders, neckline, target and stage of analysed windows."""
    at = lambda c: feed_seconds(c, offset)
    last_idx, last_ts = F.col("last_idx"), F.col("last_ts")
    swings = F.transform(
        "swings",
        lambda p, n: F.when(p["ts"].isNotNull(), _item(_named(f"{prefix}swing.", n), "arrow", at(p["ts"]), p["price"], text=p["kind"])),
    )
    lines = F.flatten(
        F.transform("trendlines", lambda l, n: _lines(_named(f"{prefix}trend.", n), "", l, last_idx, last_ts, offset))
    )

    def shoulder(column: str, label: str) -> list[Column]:
        p = F.col(column)
        have = p.isNotNull() & p["ts"].isNotNull()
        return [
            F.when(have, _item(F.lit(f"{prefix}hs.{column}.arrow"), "arrow", at(p["ts"]), p["price"])),
            F.when(have, _item(F.lit(f"{prefix}hs.{column}.text"), "text", at(p["ts"]), p["price"], text=F.lit(label))),
        ]

    target = F.when(
        (F.col("stage") == "confirmed_break") & F.col("min_target").isNotNull(),
        _item(F.lit(f"{prefix}min_target"), "hline", p1=F.col("min_target")),
    )
    stage = _item(F.lit(f"{prefix}stage"), "label", text=F.concat(F.lit("stage="), F.col("stage")))
    fixed = F.array(
        *shoulder("left_shoulder", "LS"), *shoulder("head", "H"), *shoulder("right_shoulder", "RS"), target, stage
    )
    neck = F.when(
        F.col("neckline").isNotNull(), _lines(F.lit(f"{prefix}neckline"), "", F.col("neckline"), last_idx, last_ts, offset)
    ).otherwise(F.slice(fixed, 1, 0))
    everything = F.array_compact(F.concat(swings, lines, fixed, neck))
    rows = analyses.select(*keys, F.explode(everything).alias("o"))
    return rows.select(*keys, *[f"o.{f}" for f in FIELDS])


def run_class() -> Column:
    """Display class of a run: waning first, then trend direction, then range."""
    return (
        F.when(F.col("trend_waning"), "waning")
        .when((F.col("regime") == "trend") & (F.col("direction") == "up"), "trend_up")
        .when((F.col("regime") == "trend") & (F.col("direction") == "down"), "trend_down")
        .when(F.col("regime") == "range", "range")
        .otherwise("other")
    )


def run_label() -> Column:
    regime = F.coalesce("regime", F.lit("?"))
    return (
        F.when(F.col("trend_waning"), F.concat(regime, F.lit("/waning")))
        .when(F.col("direction").isNotNull(), F.concat(regime, F.lit("/"), F.col("direction")))
        .otherwise(regime)
    )


def walk_annotations(
    runs: DataFrame, scored: DataFrame, summary: DataFrame, keys: Sequence[str], prefix: str = "walk.", show: str = "both",
    offset: int = 0, p_hat: float = WATCH_P_HAT, score: float = WATCH_INSTABILITY,
) -> DataFrame:
    """Run rectangles and labels, change-watch markers and one summary line per series.

    Names carry the run number and the watched bar, so no global numbering is needed.
    """
    if show not in SHOW:
        raise ValueError(f"show must be one of {SHOW}")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("na"))
    counts = F.array_join(
        F.array_compact(
            F.array(*[F.when(F.col("regime_counts")[r].isNotNull(), F.concat(F.lit(f"{r}="), F.col("regime_counts")[r].cast("string"))) for r in sorted(REGIMES)])
        ),
        " ",
    )
    line = F.concat(
        F.lit("walk steps="), F.col("step_count").cast("string"), F.lit(" runs="), F.col("run_count").cast("string"), F.lit(" "), counts,
        F.lit(" p_hat="), number(F.col("last_p_hat")), F.lit(" brier="), number(F.col("brier")), F.lit(f" show={show}"),
    )
    out = _explode(summary, keys, _item(F.lit(f"{prefix}label"), "label", text=line))
    if show in ("ranges", "both"):
        t1, t2 = feed_seconds(F.col("start_ts"), offset), feed_seconds(F.col("end_ts"), offset)
        timed = runs.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        name = _named(f"{prefix}run.", F.col("run"))
        out = out.unionByName(
            _explode(
                timed, keys,
                _item(name, "rectangle", t1, F.col("low"), _bounded_end(t1, t2), F.col("high"), run_class()),
                _item(_named(name, ".text"), "text", t1, F.col("high"), text=run_label()),
            )
        )
    if show in ("markers", "both"):
        watched = change_watch(scored, p_hat, score).filter(F.col("ts").isNotNull())
        t = feed_seconds(F.col("ts"), offset)
        # Two digits of the double itself, as a format prints it: 0.575 lies below its decimal and is 0.57.
        two = lambda c: F.coalesce(F.format_number(c, 2), F.lit("na"))
        name = _named(f"{prefix}watch.", F.col("idx"))
        text = F.concat(F.lit("p="), two(F.col("p_hat")), F.lit("  i="), two(F.col("instability")))
        out = out.unionByName(
            _explode(
                watched, keys,
                _item(name, "arrow", t, F.col("high")),
                _item(_named(name, ".text"), "text", t, F.col("high"), text=text),
            )
        )
    return out


def trade_annotations(trades: DataFrame, keys: Sequence[str], prefix: str = "trade.", offset: int = 0) -> DataFrame:
    """Entry arrow and side, time-bounded stop and target, and the path to the exit."""
    t1 = feed_seconds(F.col("entry_ts"), offset)
    t2 = _bounded_end(t1, feed_seconds(F.col("exit_ts"), offset))
    name = lambda part: _named(prefix, F.col("entry_idx"), f".{part}")
    flat = lambda part, c: F.when(F.col(c).isNotNull(), _item(name(part), "trend", t1, F.col(c), t2, F.col(c)))
    won = F.when(is_true(F.col("r_realized") > 0), "won").otherwise("lost")
    usable = trades.filter(F.col("entry_ts").isNotNull() & F.col("entry").isNotNull())
    return _explode(
        usable, keys,
        _item(name("arrow"), "arrow", t1, F.col("entry")),
        F.when(F.col("side").isin("long", "short"), _item(name("side"), "text", t1, F.col("entry"), text=F.col("side"))),
        flat("stop", "stop"),
        flat("target", "target"),
        F.when(F.col("exit_price").isNotNull(), _item(name("path"), "trend", t1, F.col("entry"), t2, F.col("exit_price"), won)),
    )


def ticket_problem() -> Column:
    """Why a ticket cannot be drawn; null when it can."""
    return (
        F.when(F.col("entry").isNull() | F.col("stop").isNull() | F.col("target").isNull(), "ticket requires numeric entry, stop, and target")
        .when(F.least("entry", "stop", "target") <= 0, "ticket prices must be positive")
        .when(F.col("entry") == F.col("stop"), "entry and stop must differ")
    )


def ticket_annotations(tickets: DataFrame, keys: Sequence[str], stamp: Column, prefix: str = "ticket.", offset: int = 0) -> DataFrame:
    """Level lines of drawable tickets, a time marker when ``at_ts`` is known, and a label."""
    usable = tickets.filter(ticket_problem().isNull()).withColumn("_stamp", F.coalesce(stamp, F.lit("")))
    t = feed_seconds(F.col("at_ts"), offset)
    timed = F.col("at_ts").isNotNull()
    side = F.coalesce(F.nullif(F.lower(strip(F.col("side"))), F.lit("")), F.lit("none"))
    text = lambda c: F.col(c).cast("string")
    label = F.concat(
        F.lit("ticket "), side, F.lit(" entry="), text("entry"), F.lit(" stop="), text("stop"), F.lit(" target="), text("target"),
        F.when(F.col("_stamp") != "", F.concat(F.lit(" @ "), F.col("_stamp"))).otherwise(""),
    )
    shown = F.when(F.col("_stamp") != "", F.col("_stamp")).otherwise("ticket")
    return _explode(
        usable, keys,
        *[_item(F.lit(f"{prefix}{c}"), "hline", p1=F.col(c)) for c in ("entry", "stop", "target")],
        F.when(timed, _item(F.lit(f"{prefix}time"), "vline", t)),
        F.when(timed, _item(F.lit(f"{prefix}time.arrow"), "arrow", t, F.col("entry"), text=side)),
        F.when(timed, _item(F.lit(f"{prefix}time.text"), "text", t, F.col("entry"), text=shown)),
        _item(F.lit(f"{prefix}label"), "label", text=label),
    )


def annotation_problem(style: Column | None = None, x: Column | None = None, y: Column | None = None) -> Column:
    """Why an annotation row is invalid; null when it is fine."""
    kind = F.lower(strip(F.coalesce("type", F.lit(""))))
    needs_point = kind.isin("trend", "rectangle", "text", "arrow")
    rules = [
        (~kind.isin(*TYPES), F.concat(F.lit("Unsupported object type '"), F.coalesce("type", F.lit("None")), F.lit("'"))),
        (strip(F.coalesce("name", F.lit(""))) == "", F.lit("object is missing 'name'")),
    ]
    if style is not None:
        look = F.lower(strip(F.coalesce(F.nullif(style, F.lit("")), F.lit("solid"))))
        rules.append((~look.isin(*STYLES), F.concat(F.lit("Unsupported style '"), look, F.lit("'"))))
    rules += [
        (needs_point & (F.col("t1").isNull() | F.col("p1").isNull()), F.concat(kind, F.lit(" requires t1 and p1"))),
        ((kind == "hline") & F.col("p1").isNull(), F.lit("hline requires p1")),
        ((kind == "vline") & F.col("t1").isNull(), F.lit("vline requires t1")),
    ]
    if x is not None and y is not None:
        rules.append(((kind == "label") & (x.isNull() | y.isNull()), F.lit("label requires x and y")))
    return F.coalesce(*[F.when(is_true(test), text) for test, text in rules])


def with_prefix(annotations: DataFrame, prefix: str) -> DataFrame:
    """Names that lack the prefix get it."""
    fine = F.col("name").startswith(prefix)
    return annotations.withColumn("name", F.when(fine, F.col("name")).otherwise(F.concat(F.lit(prefix), F.col("name"))))
