"""Decision journal: run and fill rows as tables.

``batch`` grows with every write and ``line`` orders the rows of one write, so
(batch, line, run_id) is the write order; timestamps are never used for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewick.functions.numbers import is_true
from candlewick.functions.text import strip
from candlewick.functions.tickets import Goal
from candlewick.sources.tables import evolve

# Fill notes and the list limit.
NOTE_QUEUED = "queued by orchestrator"
NOTE_WALK_FILL = "walk fill at decision-bar close; no broker"
NOTE_NO_PRICE = "stub: no entry or last_close"
NOTE_STUB_FILL = "stub: zero slippage; no broker"

WRITE_ORDER = ("batch", "line", "run_id")
EXIT_COLUMNS = {"exit_status": "string", "exit_price": "double", "exit_ts": "timestamp", "r_realized": "double"}
REGIME_FIELDS = ("regime", "direction", "trend_waning", "confidence", "allowed_play_classes", "ma_perfect_order", "last_close", "last_ts")
PROPOSAL_TYPE = (
    "struct<thesis:string,play_class:string,side:string,entry:double,stop:double,target:double,"
    "at_ts:timestamp,confidence:double,notes:string>"
)
REGIME_TYPE = (
    "struct<regime:string,direction:string,trend_waning:boolean,confidence:double,"
    "allowed_play_classes:array<string>,ma_perfect_order:string,last_close:double,last_ts:timestamp>"
)
RISK_TYPE = (
    "struct<ok:boolean,action:string,reasons:array<string>,r_planned:double,size_units:double,"
    "risk_fraction:double,stop_distance:double>"
)


def run_id(keys: Sequence[str], idx: str = "idx") -> Column:
    """An id that a rerun of the same decision repeats."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col(idx).cast("string")))


def run_rows(decided: DataFrame, keys: Sequence[str], goal: Goal, batch: int = 0) -> DataFrame:
    """Journal rows of decided bars (see ``outcomes.decide``), records kept as JSON text."""
    stamped = decided.withColumn("last_ts", F.col("ts"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in vars(goal).items()])
    return stamped.select(
        run_id(keys).alias("run_id"),
        "ts",
        F.lit(goal.mode).alias("mode"),
        *keys,
        F.col("risk.action").alias("action"),
        F.to_json(settings).alias("goal_json"),
        F.to_json(F.struct(*REGIME_FIELDS)).alias("regime_json"),
        F.to_json("proposal").alias("proposal_json"),
        F.to_json("risk").alias("risk_json"),
        F.lit(None).cast("string").alias("error"),
        F.lit(batch).cast("bigint").alias("batch"),
        F.col("idx").alias("line"),
    )


def pending_fills(runs: DataFrame) -> DataFrame:
    """The fill row queued for every run that waits for execution."""
    return runs.filter(F.col("action") == "pending_exec").select(
        "run_id",
        F.lit("pending").alias("status"),
        F.lit(None).cast("double").alias("fill_price"),
        "ts",
        F.lit(NOTE_QUEUED).alias("note"),
        *[F.lit(None).cast(t).alias(c) for c, t in EXIT_COLUMNS.items()],
        "batch",
        "line",
    )


def records(runs: DataFrame) -> DataFrame:
    """Runs with their JSON columns parsed back into structs."""
    return runs.withColumns(
        {
            "regime": F.from_json("regime_json", REGIME_TYPE),
            "proposal": F.from_json("proposal_json", PROPOSAL_TYPE),
            "risk": F.from_json("risk_json", RISK_TYPE),
        }
    ).drop("regime_json", "proposal_json", "risk_json")


def get_run(runs: DataFrame, wanted: str) -> DataFrame:
    return runs.filter(F.col("run_id") == wanted)


def list_runs(runs: DataFrame, limit: int = 50, instrument: str | None = None, action: str | None = None) -> DataFrame:
    """The ``limit`` newest writes, newest first."""
    if limit < 1:
        raise ValueError("limit must be >= 1")
    kept = runs
    if instrument:
        kept = kept.filter(F.col("instrument") == instrument)
    if action:
        kept = kept.filter(F.col("action") == action)
    return kept.orderBy(*[F.col(c).desc() for c in WRITE_ORDER]).limit(limit)


def pending_runs(runs: DataFrame, fills: DataFrame) -> DataFrame:
    """Runs with a pending fill and where that fill was written."""
    waiting = fills.filter(F.col("status") == "pending").select(
        "run_id", F.col("batch").alias("fill_batch"), F.col("line").alias("fill_line")
    )
    return runs.join(waiting, "run_id")


def list_pending(runs: DataFrame, fills: DataFrame) -> DataFrame:
    """Runs with a pending fill, in the order the fills were written."""
    return pending_runs(runs, fills).orderBy("fill_batch", "fill_line", "run_id")


def record_fills(fills: DataFrame, updates: DataFrame) -> DataFrame:
    """Each run's last update overwrites its pending fill, or is added when none is pending."""
    newest = F.max_by(F.struct(*updates.columns), F.struct("batch", "line", F.xxhash64(*updates.columns)))
    updates = updates.groupBy("run_id").agg(newest.alias("_u")).select("_u.*")
    changed = [c for c in fills.columns if c not in ("run_id", "batch", "line")]
    incoming = updates.select("run_id", *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_found"))
    hit = is_true(F.col("_found")) & (F.col("status") == "pending")
    merged = fills.join(incoming, "run_id", "left").withColumn("_hit", hit)
    kept = merged.select(
        "run_id", *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in changed], "batch", "line"
    )
    pending = fills.filter(F.col("status") == "pending").select("run_id")
    return kept.unionByName(updates.join(pending, "run_id", "left_anti").select(*kept.columns))


def record_exits(fills: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fills with exits attached to their filled rows, exits without a filled row)."""
    columns = [*EXIT_COLUMNS, "note"]
    incoming = exits.select("run_id", *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_found"))
    hit = is_true(F.col("_found")) & (F.col("status") == "filled_sim")
    merged = fills.join(incoming, "run_id", "left").withColumn("_hit", hit)
    updated = merged.select(
        *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in fills.columns]
    )
    filled = fills.filter(F.col("status") == "filled_sim").select("run_id")
    return updated, exits.join(filled, "run_id", "left_anti")


def latest_fills(fills: DataFrame) -> DataFrame:
    """The last written fill of every run."""
    w = Window.partitionBy("run_id").orderBy(F.col("batch").desc(), F.col("line").desc())
    return fills.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve_pending(runs: DataFrame, fills: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill updates for every pending run: at the entry, else the last close, else rejected."""
    waiting = records(pending_runs(runs, fills))
    price = F.coalesce("proposal.entry", "regime.last_close")
    return waiting.select(
        "run_id",
        F.when(price.isNull(), "rejected").otherwise("filled_sim").alias("status"),
        price.alias("fill_price"),
        (F.current_timestamp() if now is None else now).alias("ts"),
        F.when(price.isNull(), NOTE_NO_PRICE).otherwise(NOTE_STUB_FILL).alias("note"),
        *[F.lit(None).cast(t).alias(c) for c, t in EXIT_COLUMNS.items()],
        F.col("fill_batch").alias("batch"),
        F.col("fill_line").alias("line"),
    )


def walk_entries(trades: DataFrame, keys: Sequence[str], decided: DataFrame, goal: Goal, batch: int = 0) -> tuple[DataFrame, DataFrame]:
    """(run rows, filled fill rows with exits) of walked trades; never queued as pending."""
    taken = decided.join(trades.select(*keys, F.col("entry_idx").alias("idx")), [*keys, "idx"], "left_semi")
    fills = trades.select(
        run_id(keys, "entry_idx").alias("run_id"),
        F.lit("filled_sim").alias("status"),
        F.col("entry").alias("fill_price"),
        F.col("entry_ts").alias("ts"),
        F.when(F.col("exit_status").isNull(), NOTE_WALK_FILL).otherwise(F.concat(F.lit("walk exit "), F.col("exit_status"))).alias("note"),
        *EXIT_COLUMNS,
        F.lit(batch).cast("bigint").alias("batch"),
        F.col("entry_idx").alias("line"),
    )
    return run_rows(taken, keys, goal, batch), fills


def add_exit_columns(fills: DataFrame) -> DataFrame:
    """An older fills table with the exit columns it may lack."""
    missing = {c: F.lit(None).cast(t) for c, t in EXIT_COLUMNS.items() if c not in fills.columns}
    return fills.withColumns(missing) if missing else fills


def append_fills(old: DataFrame, new: DataFrame) -> DataFrame:
    return add_exit_columns(evolve(old, new))


def run_summary(runs: DataFrame) -> DataFrame:
    """Flat listing of runs out of their records."""
    return records(runs).select(
        "run_id", "ts", "mode", "instrument", "granularity", "action",
        F.col("regime.regime").alias("regime"),
        F.col("regime.trend_waning").alias("trend_waning"),
        *[F.col(f"proposal.{c}").alias(c) for c in ("side", "stop", "target")],
        "error",
    )


def stored_tickets(runs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tickets of wanted runs, rejects with reason).

    ``wanted``: run_id and optional overrides instrument, granularity, side, at_ts.
    """
    blank = lambda c: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    asked = wanted.select(
        "run_id",
        blank("instrument").alias("_instrument"),
        F.col("granularity").alias("_granularity"),
        F.nullif(blank("side"), F.lit("none")).alias("_side"),
        F.col("at_ts").alias("_at"),
    )
    found = asked.join(records(runs), "run_id", "left")
    p = F.col("proposal")
    reason = F.when(F.col("mode").isNull(), F.concat(F.lit("run not found: "), F.col("run_id"))).when(
        p.isNull() | p["entry"].isNull() | p["stop"].isNull() | p["target"].isNull(),
        "run has no complete ticket (entry/stop/target)",
    )
    marked = found.withColumn("reason", reason)
    tickets = marked.filter(F.col("reason").isNull()).select(
        "run_id",
        F.coalesce("_instrument", "instrument").alias("instrument"),
        F.when(F.col("_instrument").isNotNull(), F.col("_granularity")).otherwise(F.col("granularity")).alias("granularity"),
        F.coalesce("_side", p["side"]).alias("side"),
        *[p[c].alias(c) for c in ("entry", "stop", "target")],
        F.coalesce("_at", "regime.last_ts", "ts").alias("at_ts"),
    )
    return tickets, marked.filter(F.col("reason").isNotNull()).select("run_id", "action", "reason")
