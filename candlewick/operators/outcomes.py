"""Ticketed candidates, their first-touch exits (``exits``) and one-position selection (``chains``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from candlewick.functions.numbers import rounded
from candlewick.functions.tickets import (
    Goal, apply_geometry, expectancy, first_exit, planned_prices, r_multiple, skeleton_proposal, with_action, with_ticket, with_verdict,
)
from candlewick.operators.chains import select_sequential
from candlewick.operators.exits import first_touches
from candlewick.session import stored_once

#: Copies of a series' last bar that positions still open at the end are dealt over.
SALTS = 16


def decide(labelled: DataFrame, goal: Goal, instrument: str = "instrument") -> DataFrame:
    """Skeleton proposal, geometry and gate verdict for every classified row."""
    proposed = labelled.withColumn("_skeleton", skeleton_proposal())
    planned = with_ticket(proposed, F.col("_skeleton.play_class"), F.col(instrument), name="_ticket")
    shaped = planned.withColumn("proposal", apply_geometry(F.col("_skeleton"), F.col("_ticket"), F.col("ts")))
    return with_verdict(shaped, goal).drop("_skeleton", "_ticket")


def entry_candidates(labelled: DataFrame, keys: Sequence[str], goal: Goal = Goal(mode="paper")) -> DataFrame:
    """Rows the gate would send to execution, with their ticket: as ``decide`` has it, without its texts."""
    proposed = labelled.withColumn("_play", skeleton_proposal()["play_class"])
    planned = with_ticket(proposed, F.col("_play"), F.col("instrument"), name="_ticket")
    shaped = planned.withColumn("proposal", F.struct(F.col("_play").alias("play_class"), *planned_prices(F.col("_ticket"))))
    passed = with_action(shaped, goal).filter(F.col("action") == "pending_exec")
    return passed.select(
        *keys,
        F.col("idx").alias("entry_idx"),
        F.col("ts").alias("entry_ts"),
        *[F.col(f"proposal.{c}").alias(c) for c in ("side", "play_class", "entry", "stop", "target")],
    )


def resolve_exits(candidates: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add exit_idx, exit_ts, exit_price, exit_status and r_realized to every candidate.

    Exits are looked for from the next bar on; never reached means ``window_end``
    at the last close. ``bars`` is read several times: pass a stored table or a persisted frame.
    """
    keys = list(keys)
    long_side = F.col("side") == "long"
    start = candidates.withColumns(
        {
            "_floor": F.when(long_side, F.col("stop")).otherwise(F.col("target")),
            "_ceiling": F.when(long_side, F.col("target")).otherwise(F.col("stop")),
            "_entry": F.col("entry_idx"),
        }
    )
    touched = stored_once(first_touches(start, bars, keys), "touched")
    last = F.struct("idx", "ts", "close")
    ends = bars.groupBy(*keys).agg(F.max_by(last, "idx").alias("_end"))
    salted = ends.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    # Only what stays open meets the last bar of its series; all else is not dealt again.
    left_open = touched.filter("_hit is null").withColumn("_salt", F.pmod("_entry", F.lit(SALTS))).join(salted, [*keys, "_salt"], "left")
    ended = touched.filter("_hit is not null").unionByName(left_open, allowMissingColumns=True)
    status = F.coalesce(
        first_exit(F.col("side"), F.col("stop"), F.col("target"), F.col("_hit_high"), F.col("_hit_low")), F.lit("window_end")
    )
    closed = ended.withColumn("exit_status", status).withColumns(
        {
            "exit_idx": F.coalesce("_hit", "_end.idx"),
            "exit_ts": F.coalesce("_hit_ts", "_end.ts"),
            "exit_price": F.when(status == "stop", F.col("stop")).when(status == "target", F.col("target")).otherwise(F.col("_end.close")),
        }
    )
    return close_trades(closed).select(
        *candidates.columns, "exit_idx", "exit_ts", "exit_price", "exit_status", "r_realized"
    )


def close_trades(trades: DataFrame) -> DataFrame:
    """Realized R of each exit, four digits."""
    return trades.withColumn("r_realized", rounded(r_multiple(F.col("entry"), F.col("stop"), F.col("exit_price")), 4))


def walk_trades(labelled: DataFrame, bars: DataFrame, keys: Sequence[str], goal: Goal = Goal(mode="paper")) -> DataFrame:
    """Candidates, exits and one-position selection; ``labelled`` is read once.

    Candidates are a few narrow columns of the labels and are read twice: they are stored, and no other column is made.
    So are their exits; the shuffles of bars that made them are freed.
    """
    candidates = stored_once(entry_candidates(labelled, keys, goal), "candidates")
    trades = stored_once(resolve_exits(candidates, bars, keys), "exits")
    return select_sequential(trades, keys)


def trade_expectancy(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win rate, mean win, mean loss and expectancy in R per group."""
    r = F.col("r_realized")
    grouped = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win_r"),
        F.coalesce(F.avg(F.when(r <= 0, -r)), F.lit(0.0)).alias("avg_loss_r"),
    )
    return grouped.withColumn("expectancy", expectancy(F.col("win_rate"), F.col("avg_win_r"), F.col("avg_loss_r")))
