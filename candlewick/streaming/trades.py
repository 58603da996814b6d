"""Streaming trades and fills."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.chains import select_sequential
from candlewick.operators.journal import resolve_pending
from candlewick.operators.outcomes import resolve_exits
from candlewick.session import stored_once
from candlewick.sources.bucketed import BucketedTable
from candlewick.sources.tables import VERSION

TICKET = ("entry_idx", "entry_ts", "side", "play_class", "entry", "stop", "target")


def advance_trades(bars: DataFrame, opened: DataFrame | None, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(closed trades, open tickets) after some more decided bars of every series.

    ``bars``: keys, idx, ts, high, low, close and, where the gate passed, side, play_class, entry, stop, target (else null
    side), all later than those seen before; ``opened``: keys and the ticket of series that hold one. Exits are searched in the new bars
    alone, since an open ticket was not touched before; it is the first of its series' chain.
    """
    keys = list(keys)
    fresh = bars.filter(F.col("side").isin("long", "short")).select(
        *keys, F.col("idx").alias("entry_idx"), F.col("ts").alias("entry_ts"), *TICKET[2:]
    )
    seen = bars.select(*keys).distinct()
    waiting = None if opened is None else opened.join(seen, keys, "left_anti")
    if opened is not None:
        fresh = fresh.unionByName(opened.join(seen, keys, "left_semi").select(*fresh.columns))
    trades = stored_once(resolve_exits(fresh, bars, keys), "stream-exits")
    taken = stored_once(select_sequential(trades, keys), "stream-taken")
    still = taken.filter(F.col("exit_status") == "window_end").select(*keys, *TICKET)
    return taken.filter(F.col("exit_status") != "window_end"), still if waiting is None else still.unionByName(waiting.select(*still.columns))


def stream_trades(decided: DataFrame, keys: Sequence[str], root: str, checkpoint: str) -> StreamingQuery:
    """Closed trades of a stream of decided bars, one open position per series, written under ``root/closed``.

    Every micro-batch runs the batch operators over its own bars and the tickets still open, which
    are its state under ``root/open``; bars of a series come in order from batch to batch. A batch that is repeated after a
    failure replaces what it wrote. ``root/open/batch=N`` needs batch N - 1 alone; older ones may go.
    """
    root, keys = root.rstrip("/"), list(keys)

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bars = stored_once(batch, "stream-bars")
        opened = spark.read.parquet(f"{root}/open/batch={batch_id - 1}") if batch_id else None
        closed, still = advance_trades(bars, opened, keys)
        closed.write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
        still.write.mode("overwrite").parquet(f"{root}/open/batch={batch_id}")

    return decided.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_fills(old: DataFrame, queued: DataFrame, runs: DataFrame, version: Column) -> DataFrame:
    """One fill row per run after a batch of queued ones: pending rows are resolved, runs already filled stay as they are."""
    settled = old.filter(F.col("status") != "pending").select("run_id")
    waiting = queued.filter(F.col("status") == "pending").join(settled, "run_id", "left_anti")
    updates = resolve_pending(runs, waiting).withColumn(VERSION, version)
    return old.join(updates.select("run_id"), "run_id", "left_anti").unionByName(updates, allowMissingColumns=True)


def stream_fills(pending: DataFrame, runs: Callable[[DataFrame], DataFrame], fills: BucketedTable, checkpoint: str, after: int = 0) -> StreamingQuery:
    """Merge every pending fill that arrives, resolved, into the latest-fill table.

    ``runs`` gives the run rows of a frame with ``run_id`` (``BucketedTable.rows_for`` opens only the
    buckets that can hold them). Batch 0 is the version after ``after``, the one the table had when the
    checkpoint was new. A batch rewrites the buckets of its runs alone, and one that is
    repeated after a failure changes nothing that it changed before.
    """

    def resolve(batch: DataFrame, batch_id: int) -> None:
        version = after + 1 + batch_id
        fills.merge(batch, version, lambda old, queued: merged_fills(old, queued, runs(queued), F.lit(version)), ["batch", "line"])

    return pending.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
