"""Walk-forward labels, probabilities, runs and trades of many series in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from candlewick.functions.tickets import Goal
from candlewick.operators.journal import walk_entries
from candlewick.operators.outcomes import decide, walk_trades
from candlewick.operators.series import first_index, index_rows
from candlewick.operators.walk import attach_change_prob, collapse_runs, label_steps, start_rejects, summarize
from candlewick.session import stored_once
from candlewick.sources.candles import clean_bars, walk_range


@dataclass
class WalkForward:
    steps: DataFrame
    runs: DataFrame
    summary: DataFrame
    trades: DataFrame
    journal_runs: DataFrame
    journal_fills: DataFrame
    rejects: DataFrame


def walk_forward(
    bars: DataFrame,
    keys: Sequence[str],
    frm: Column | None = None,
    to: Column | None = None,
    lookback: int = 250,
    horizon: int = 5,
    min_n: int = 10,
    goal: Goal = Goal(mode="paper"),
    arrival: Sequence[str] = (),
) -> WalkForward:
    """Labels are computed once, persisted, and feed every branch.

    Bars are cleaned first: incomplete ones and repeats of a time go, untimed and
    unusable ones are rejects. With ``frm`` and ``to`` only warm-up plus that range is
    used, and the first label is the first bar at or after ``frm``; a series that
    cannot start there is a reject and the others go on.
    """
    good, rejects = clean_bars(bars, keys, to, arrival)
    good = stored_once(good.drop("idx"), "walk-bars")
    chosen = good if frm is None or to is None else walk_range(good, keys, frm, to, lookback, arrival)
    numbered = index_rows(chosen, keys).persist()
    start = None if frm is None else first_index(numbered, keys, frm)
    if start is not None:
        late = start_rejects(good, keys, start, lookback)
        rejects = rejects.unionByName(late, allowMissingColumns=True)
    labelled = label_steps(numbered, keys, lookback, start=start).persist()
    scored = attach_change_prob(labelled, keys, horizon, min_n)
    runs = collapse_runs(labelled, keys)
    trades = walk_trades(labelled, numbered, keys, goal).persist()
    journal_runs, journal_fills = walk_entries(trades, keys, decide(labelled, goal), goal)
    return WalkForward(scored, runs, summarize(scored, runs, keys), trades, journal_runs, journal_fills, rejects)
