"""One decision per series from its last bars: classify, retrieve, propose, gate, journal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.text import regime_query
from candlewick.functions.tickets import Goal, apply_geometry, skeleton_proposal, with_ticket, with_verdict
from candlewick.operators.journal import pending_fills, run_rows
from candlewick.operators.regime import analyze_last
from candlewick.operators.retrieval import citations, cosine_top_k, with_chunks


@dataclass
class Decisions:
    decided: DataFrame
    runs: DataFrame
    pending: DataFrame
    rejects: DataFrame


def decide_latest(
    bars: DataFrame, keys: Sequence[str], goal: Goal = Goal(), count: int = 250,
    propose: Callable[[DataFrame], DataFrame] | None = None, batch: int = 0,
) -> Decisions:
    """``propose`` may add a ``proposal`` struct to classified rows; else the skeleton is used.

    Waning rows never get a proposal. Prices always come from the geometry.
    """
    classified, rejects = analyze_last(bars, keys, count)
    proposed = classified.withColumn("proposal", skeleton_proposal()) if propose is None else propose(classified)
    raw = proposed.withColumn("_raw", F.when(~F.col("trend_waning"), F.col("proposal")))
    planned = with_ticket(raw, F.col("_raw.play_class"), F.col("instrument"), name="_ticket")
    shaped = planned.withColumn("proposal", apply_geometry(F.col("_raw"), F.col("_ticket"), F.col("ts")))
    decided = with_verdict(shaped, goal).drop("_raw", "_ticket")
    runs = run_rows(decided, keys, goal, batch)
    return Decisions(decided, runs, pending_fills(runs), rejects)


def regime_queries(classified: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(query_id, query, embedding), one per distinct question of non-waning rows."""
    asked = classified.filter(~F.col("trend_waning")).select(
        regime_query(F.col("regime"), F.col("direction"), F.col("allowed_play_classes")).alias("query")
    ).distinct()
    return asked.select(F.col("query").alias("query_id"), "query", embed(F.col("query")).alias("embedding"))


def retrieve_for(classified: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """Citations per question of the classified rows."""
    hits = cosine_top_k(regime_queries(classified, embed), chunks, k)
    return citations(with_chunks(hits, chunks.drop("embedding")))
