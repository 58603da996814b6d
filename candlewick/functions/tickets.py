"""Entry, stop and target geometry, sizing and the decision gate: row-local, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.numbers import computed_once, is_true, whole_even
from candlewick.functions.text import strip

# Ticket geometry and gate limits.
PLANNED_R = 2.0
MIN_R = 2.0
BUFFER_PIPS = 10
JPY_PIP, DEFAULT_PIP = 0.01, 0.0001

# Skeleton texts.
SKELETON_THESIS = "no-llm skeleton; Ch.7 geometry fills prices from the snapshot"
SKELETON_NOTES = "--no-llm"

SMA_LEVELS = ("sma_10", "sma_20", "sma_50", "sma_100", "sma_200")
BAND_LEVELS = ("bb_mid", "bb_upper_1", "bb_upper_2", "bb_lower_1", "bb_lower_2")


@dataclass(frozen=True)
class Goal:
    """Account and risk settings of a decision."""

    mode: str = "signal"
    balance: float = 10_000.0
    risk_fraction: float = 0.02
    open_risk_fraction: float = 0.0
    exposure_cap: float = 0.06
    value_per_price_unit: float = 1.0


def pip_size(instrument: Column) -> Column:
    text = F.replace(F.upper(strip(instrument)), F.lit("/"), F.lit("_"))
    quote = F.when(text.contains("_"), F.element_at(F.split(text, "_"), -1)).otherwise(F.right(text, F.lit(3)))
    return F.when(quote == "JPY", JPY_PIP).otherwise(DEFAULT_PIP)


def round_to_pip(price: Column, pip: Column) -> Column:
    """Half-even to a whole number of pips."""
    return whole_even(price / pip) * pip


def named_levels() -> Column:
    """Map of the levels a snapshot row has."""
    names = ("last_close", *SMA_LEVELS, *BAND_LEVELS, "high_n", "low_n")
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())


def mid_level() -> Column:
    """Band middle, else SMA-20, else the midpoint of the recent extremes."""
    return F.coalesce(F.col("bb_mid"), F.col("sma_20"), (F.col("high_n") + F.col("low_n")) / 2.0)


def r_multiple(entry: Column, stop: Column, exit_price: Column) -> Column:
    """Result in units of initial risk; null when entry equals stop."""
    return (exit_price - entry) / F.nullif(entry - stop, F.lit(0.0))


def size_problem(balance: Column, fraction: Column, distance: Column, unit_value: Column) -> Column:
    return (
        F.when(balance <= 0, "account_balance must be positive")
        .when(~((fraction > 0) & (fraction <= 1)), "risk_fraction must be in (0, 1]")
        .when(distance <= 0, "stop_distance_price must be positive")
        .when(unit_value <= 0, "value_per_price_unit must be positive")
    )


def position_size(balance: Column, fraction: Column, distance: Column, unit_value: Column) -> Column:
    """Units that risk a fixed fraction of the balance; null on invalid input."""
    fine = size_problem(balance, fraction, distance, unit_value).isNull()
    return F.when(fine, balance * fraction / (distance * unit_value))


def expectancy(win_rate: Column, avg_win: Column, avg_loss: Column) -> Column:
    """Expected R per trade; null on invalid input."""
    fine = win_rate.between(0, 1) & (avg_win >= 0) & (avg_loss >= 0)
    return F.when(fine, win_rate * avg_win - (1 - win_rate) * avg_loss)


def exposure_allows(open_risk: Column, new_risk: Column, cap: Column) -> Column:
    """Whether the total stays within the cap; null on negative input."""
    return F.when((open_risk >= 0) & (new_risk >= 0) & (cap >= 0), open_risk + new_risk <= cap)


def _rail(side: str) -> tuple[Column, Column]:
    """(price, name) of the level a stop hides behind: recent extreme, else the one-sigma band."""
    extreme, band = ("low_n", "bb_lower_1") if side == "low" else ("high_n", "bb_upper_1")
    return F.coalesce(F.col(extreme), F.col(band)), F.when(F.col(extreme).isNotNull(), extreme).otherwise(band)


def trade_side(play: Column) -> Column:
    """long / short of a classified row: with the trend, or against the far side of the range."""
    close, high, low = F.col("last_close"), _rail("high")[0], _rail("low")[0]
    mid = mid_level()
    go_short = F.when(mid.isNotNull(), close >= mid).otherwise(F.abs(high - close) <= F.abs(close - low))
    fade = F.when(high.isNotNull() & low.isNotNull(), F.when(go_short, "short").otherwise("long"))
    follow = F.when(F.col("direction") == "up", "long").when(F.col("direction") == "down", "short")
    usable = ~F.col("trend_waning") & close.isNotNull()
    return F.when(usable & (play == "join_trend"), follow).when(usable & (play == "fade_range"), fade)


def finish_ticket(df: DataFrame, side: str, close: str, stop_level: str, stop_name: str, pip: str, name: str) -> DataFrame:
    """Add the struct ``name``: pip-rounded entry, stop and 2R target; null when impossible.

    One extra pip of target makes up for rounding; below 2R after that, no ticket.
    Each stage is its own projection so that no expression is computed twice.
    """
    s, p = F.col(side), F.col(pip)
    e, x = F.col("_entry"), F.col("_stop")
    staged = (
        df.withColumns({"_entry": round_to_pip(F.col(close), p), "_stop": round_to_pip(F.col(stop_level), p)})
        .withColumns({"_gap": F.abs(e - x), "_sign": F.when(s == "long", 1.0).otherwise(-1.0)})
        .withColumn("_plain", round_to_pip(e + F.col("_sign") * PLANNED_R * F.col("_gap"), p))
        .withColumn("_nudged", round_to_pip(F.col("_plain") + F.col("_sign") * p, p))
        .withColumns({"_plain_r": r_multiple(e, x, F.col("_plain")), "_nudged_r": r_multiple(e, x, F.col("_nudged"))})
        .withColumn(
            "_target", F.when(F.col("_plain_r") >= PLANNED_R, F.col("_plain")).when(F.col("_nudged_r") >= PLANNED_R, F.col("_nudged"))
        )
    )
    right_way = F.when(s == "long", x < e).when(s == "short", x > e)
    fields = F.struct(
        s.alias("side"), e.alias("entry"), x.alias("stop"), F.col("_target").alias("target"),
        F.lit("last_close").alias("entry_name"), F.col(stop_name).alias("stop_name"),
    )
    possible = is_true(right_way) & is_true(F.col("_gap") >= p) & F.col("_target").isNotNull()
    return computed_once(staged, name, F.when(possible, fields)).drop(
        "_entry", "_stop", "_gap", "_sign", "_plain", "_nudged", "_plain_r", "_nudged_r", "_target"
    )


def with_ticket(df: DataFrame, play: Column, instrument: Column, buffer_pips: int = BUFFER_PIPS, name: str = "ticket") -> DataFrame:
    """Add the planned ticket of classified rows; null for waning or unticketed plays."""
    (low, low_name), (high, high_name) = _rail("low"), _rail("high")
    buffer = F.lit(buffer_pips) * F.col("_pip")
    staged = (
        df.withColumns({"_pip": pip_size(instrument), "_side": trade_side(play)})
        .withColumns(
            {
                "_level": F.when(F.col("_side") == "long", low - buffer).otherwise(high + buffer),
                "_stop_name": F.when(F.col("_side") == "long", low_name).otherwise(high_name),
            }
        )
    )
    return finish_ticket(staged, "_side", "last_close", "_level", "_stop_name", "_pip", name).drop("_pip", "_side", "_level", "_stop_name")


def merge_notes(existing: Column, extra: Column) -> Column:
    return F.concat_ws("; ", F.nullif(strip(F.coalesce(existing, F.lit(""))), F.lit("")), extra)


def skeleton_proposal() -> Column:
    """The proposal used when no model answers: first allowed play, no prices."""
    return F.struct(
        F.lit(SKELETON_THESIS).alias("thesis"),
        F.coalesce(F.try_element_at("allowed_play_classes", F.lit(1)), F.lit("breakout_watch")).alias("play_class"),
        F.lit("none").alias("side"),
        *[F.lit(None).cast("double").alias(c) for c in ("entry", "stop", "target")],
        F.lit(None).cast("timestamp").alias("at_ts"),
        F.lit(0.0).alias("confidence"),
        F.lit(SKELETON_NOTES).alias("notes"),
    )


def planned_prices(planned: Column) -> list[Column]:
    """Side and prices of a planned ticket; side none where there is no ticket."""
    side = F.when(planned.isNull(), "none").otherwise(planned["side"]).alias("side")
    return [side, *[planned[c].alias(c) for c in ("entry", "stop", "target")]]


def apply_geometry(proposal: Column, planned: Column, last_ts: Column) -> Column:
    """Replace a proposal's side and prices by the planned ticket, noting why."""
    none = planned.isNull()
    reason = F.when(proposal["play_class"] == "breakout_watch", "ch7 geometry: breakout_watch, no ticket").otherwise(
        "ch7 geometry: no ticket"
    )
    note = F.format_string(
        f"ch7 geometry: %s entry=%s stop=%s buffer={BUFFER_PIPS}pip target={PLANNED_R:.0f}R",
        planned["side"], planned["entry_name"], planned["stop_name"],
    )
    return F.when(
        proposal.isNotNull(),
        F.struct(
            proposal["thesis"].alias("thesis"),
            proposal["play_class"].alias("play_class"),
            *planned_prices(planned),
            F.coalesce(last_ts, proposal["at_ts"]).alias("at_ts"),
            proposal["confidence"].alias("confidence"),
            merge_notes(proposal["notes"], F.when(none, reason).otherwise(note)).alias("notes"),
        ),
    )


def pass_action(play: Column, mode: Column) -> Column:
    return F.when((play != "breakout_watch") & (mode == "paper"), "pending_exec").otherwise("log_setup")


def _list_text(items: Column) -> Column:
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _ruled(df: DataFrame, goal: Goal, proposal: str) -> tuple[DataFrame, list[tuple[str, Column, Column]]]:
    """Rows with ``_failed``, the first failing rule, and what it was measured by; the rules (name, test, reason)."""
    p = F.col(proposal)
    allowed = F.coalesce(F.col("allowed_play_classes"), F.array().cast("array<string>"))
    lit = {k: F.lit(v) for k, v in vars(goal).items()}
    account = (lit["balance"], lit["risk_fraction"], F.col("_gap"), lit["value_per_price_unit"])
    missing = F.array_compact(
        F.array(
            F.when(p["side"] == "none", "side"), F.when(p["entry"].isNull(), "entry"), F.when(p["stop"].isNull(), "stop")
        )
    )
    allows = exposure_allows(lit["open_risk_fraction"], lit["risk_fraction"], lit["exposure_cap"])
    measured = df.withColumns(
        {"_missing": missing, "_gap": F.abs(p["entry"] - p["stop"]), "_r": r_multiple(p["entry"], p["stop"], p["target"])}
    ).withColumns({"_size_problem": size_problem(*account), "_size": position_size(*account)})
    rules = [
        ("waning", F.col("trend_waning"), F.lit("trend_waning: do not aggress")),
        ("proposal", p.isNull(), F.lit("no proposal")),
        (
            "play",
            ~F.array_contains(allowed, p["play_class"]),
            F.concat(F.lit("play_class '"), p["play_class"], F.lit("' not in allowed_play_classes "), _list_text(allowed)),
        ),
        ("missing", F.size("_missing") > 0, F.concat(F.lit("missing "), F.array_join("_missing", ", "))),
        ("target", p["target"].isNull(), F.lit("missing target (need planned R)")),
        ("long", (p["side"] == "long") & ~(p["stop"] < p["entry"]), F.lit("long requires stop below entry")),
        ("short", (p["side"] == "short") & ~(p["stop"] > p["entry"]), F.lit("short requires stop above entry")),
        ("risk", F.col("_r").isNull(), F.lit("entry and stop must differ (risk cannot be zero)")),
        ("low_r", F.col("_r") < MIN_R, F.format_string(f"planned R %.3f < {MIN_R:.1f}", F.col("_r"))),
        ("size", F.col("_size_problem").isNotNull(), F.col("_size_problem")),
        (
            "cap",
            ~is_true(allows),
            F.lit(f"open risk {goal.open_risk_fraction} + new {goal.risk_fraction} > cap {goal.exposure_cap}"),
        ),
    ]
    failed = F.coalesce(*[F.when(is_true(test), rule) for rule, test, _ in rules])
    return measured.withColumn("_failed", failed), rules


def _action(p: Column, goal: Goal) -> Column:
    return F.when(F.col("_failed").isNull(), pass_action(p["play_class"], F.lit(goal.mode))).otherwise("wait")


_MEASURES = ("_missing", "_gap", "_r", "_size_problem", "_size", "_failed")


def with_action(df: DataFrame, goal: Goal, proposal: str = "proposal", name: str = "action") -> DataFrame:
    """The action of ``with_verdict`` alone, without its reasons and sizes, which are long texts to make."""
    return computed_once(_ruled(df, goal, proposal)[0], name, _action(F.col(proposal), goal)).drop(*_MEASURES)


def with_verdict(df: DataFrame, goal: Goal, proposal: str = "proposal", name: str = "risk") -> DataFrame:
    """Ordered risk gate over classified rows: struct (ok, action, reasons, r_planned, size_units, ...).

    The first failing rule decides and means ``wait``.
    """
    measured, rules = _ruled(df, goal, proposal)
    reason = F.coalesce(*[F.when(F.col("_failed") == rule, text) for rule, _, text in rules])
    known = F.col("_failed").isNull() | F.col("_failed").isin("low_r", "size", "cap")
    sized = F.col("_failed").isNull() | (F.col("_failed") == "cap")
    verdict = F.struct(
        F.col("_failed").isNull().alias("ok"),
        _action(F.col(proposal), goal).alias("action"),
        F.array_compact(F.array(reason)).alias("reasons"),
        F.when(known, F.col("_r")).alias("r_planned"),
        F.when(sized, F.col("_size")).alias("size_units"),
        F.lit(goal.risk_fraction).alias("risk_fraction"),
        F.when(known, F.col("_gap")).alias("stop_distance"),
    )
    return computed_once(measured, name, verdict).drop(*_MEASURES)


def first_exit(side: Column, stop: Column, target: Column, high: Column, low: Column) -> Column:
    """stop / target / null for one bar; the stop wins when both trade."""
    long_exit = F.when(low <= stop, "stop").when(high >= target, "target")
    short_exit = F.when(high >= stop, "stop").when(low <= target, "target")
    return F.when(side == "long", long_exit).when(side == "short", short_exit)
