"""Streaming runs over the same tables, checked against the batch answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.operators import journal, outcomes
from candlewick.plans.catalog.inputs import KEYS, LOOKBACK, hourly, hourly_labels, hourly_ticks, out, outer, sql, table
from candlewick.plans.catalog.trades import PAPER
from candlewick.plans.registry import query
from candlewick.session import fresh_path
from candlewick.sources.bucketed import BucketedTable
from candlewick.sources.tables import VERSION
from candlewick.streaming.bars import drop_repeats, month_bars, stream_bars
from candlewick.streaming.labels import LATE, stream_labels
from candlewick.streaming.runs import arrivals, drain, drain_arrivals
from candlewick.streaming.trades import stream_fills, stream_trades


def _as_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A file stream over a stored copy of ``df``."""
    return next(arrivals(spark, [df], name))


@query("x1_stream_bars", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, open, high, low, close, volume FROM hb
    WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", "hb"))
def stream_bars_query(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    bars = stream_bars(events, F.col("event_type"), "H1", F.col("ts").cast("timestamp"), F.col("value"), F.col("event_id"))
    return out(drain(spark, bars, "x1"), "instrument", "ts", "open", "high", "low", "close", "volume")


@query("x1_stream_weekly", """
    SELECT instrument, epoch(week)::BIGINT AS ts, open, high, low, close, volume FROM (
        SELECT event_type AS instrument, date_trunc('week', ts)::TIMESTAMP AS week, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high,
            round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
    WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_weekly(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    bars = stream_bars(events, F.col("event_type"), "W", F.col("ts").cast("timestamp"), F.col("value"), F.col("event_id"))
    return out(drain(spark, bars, "x1-weeks"), "instrument", "ts", "open", "high", "low", "close", "volume")


@query("x1_stream_monthly", """
    WITH p AS (SELECT 'SUP_' || l_suppkey AS instrument, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS tie, l_extendedprice / l_quantity AS price FROM lineitem)
    SELECT instrument, epoch(month)::BIGINT AS ts, open, high, low, close, volume FROM (
        SELECT instrument, date_trunc('month', ts)::TIMESTAMP AS month, round(arg_min(price, (ts, tie)), 8) AS open, round(max(price), 8) AS high,
            round(min(price), 8) AS low, round(arg_max(price, (ts, tie)), 8) AS close, count(*) AS volume FROM p GROUP BY 1, 2)
    WHERE month + INTERVAL 1 MONTH <= (SELECT max(ts) FROM p)""")
def stream_monthly(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    name = F.concat(F.lit("SUP_"), F.col("l_suppkey").cast("string"))
    tie = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    days = stream_bars(lines, name, "D", F.col("l_shipdate").cast("timestamp"), F.col("l_extendedprice") / F.col("l_quantity"), tie)
    return out(month_bars(drain(spark, days, "x1-days")), "instrument", "ts", "open", "high", "low", "close", "volume", digits=8)


@query("x1_stream_calendar_months", """
    WITH p AS (SELECT 'SUP_' || l_suppkey AS instrument, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS tie, l_extendedprice / l_quantity AS price FROM lineitem)
    SELECT instrument, epoch(month)::BIGINT AS ts, open, high, low, close, volume FROM (
        SELECT instrument, date_trunc('month', ts)::TIMESTAMP AS month, round(arg_min(price, (ts, tie)), 8) AS open, round(max(price), 8) AS high,
            round(min(price), 8) AS low, round(arg_max(price, (ts, tie)), 8) AS close, count(*) AS volume FROM p GROUP BY 1, 2)
    WHERE month + INTERVAL 1 MONTH <= (SELECT max(ts) FROM p) - INTERVAL 10 MINUTE""")
def stream_calendar_months(spark, sf):
    """Months closed by the stream itself."""
    schema = table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    name = F.concat(F.lit("SUP_"), F.col("l_suppkey").cast("string"))
    tie = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    months = stream_bars(lines, name, "M", F.col("l_shipdate").cast("timestamp"), F.col("l_extendedprice") / F.col("l_quantity"), tie)
    return out(drain(spark, months, "x1-months"), "instrument", "ts", "open", "high", "low", "close", "volume", digits=8)


@query("x2_stream_without_repeats", outer("hb", "instrument, epoch(ts)::BIGINT AS ts"))
def stream_without_repeats(spark, sf):
    bars = hourly_ticks(spark, sf).select("instrument", "ts", "close")
    stream = _as_stream(spark, bars.unionByName(bars), "x2-in")
    return out(drain(spark, drop_repeats(stream), "x2"), "instrument", "ts")


_LABELS = "regime, direction, trend_waning, trend_n::BIGINT AS trend_x_count, range_n::BIGINT AS range_x_count, confidence, adx"
SLICES, DELAY = 5, 6 * 3600


@query("x3_stream_labels", sql(f"""SELECT instrument, epoch(ts)::BIGINT AS ts, idx, {_LABELS}, NULL::VARCHAR AS reason FROM x_hlab
    UNION ALL SELECT instrument, epoch(ts)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{LATE}' FROM late""", "x_hlab", "late"))
def stream_labels_query(spark, sf):
    """Bars in slices of time, every fortieth one slice late: some are within the delay, some come out as late. The last slice moves every clock a day on."""
    bars = hourly(spark, sf).select(*KEYS, "ts", "idx", "open", "high", "low", "close")
    low, high = bars.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    place = F.floor((F.unix_seconds("ts") - low) * (SLICES - 1) / (high - low + 1)) + (F.col("idx") % 40 == 3).cast("int")
    clocks = bars.groupBy(*KEYS).agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    slices = [bars.filter(place == i).drop("idx") for i in range(SLICES)]
    slices[-1] = slices[-1].unionByName(clocks, allowMissingColumns=True)
    labels = drain_arrivals(spark, slices, lambda arrived: stream_labels(arrived, KEYS, LOOKBACK, DELAY), "x3")
    names = ("regime", "direction", "trend_waning", "trend_x_count", "range_x_count", "confidence", "adx")
    told = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in names]
    return out(labels.select("instrument", "ts", "idx", *told, "reason"))


@query("x4_stream_fills", outer("cands", """md5(instrument || '|H1|' || entry_idx) AS run_id, 'filled_sim' AS status,
    CASE side WHEN 'short' THEN 0.5 ELSE round(entry, 6) END AS fill_price, CASE side WHEN 'short' THEN 'stop' END AS exit_status,
    CASE side WHEN 'short' THEN 1 ELSE 2 + entry_idx % 2 END::BIGINT AS version"""))
def stream_fills_query(spark, sf):
    """Two batches by the line's parity and a third that queues every run again; short runs were filled and closed before."""
    decided = journal.run_rows(outcomes.decide(hourly_labels(spark, sf), PAPER), KEYS, PAPER)
    runs = BucketedTable(spark, fresh_path(spark, "x4-runs"), "run_id", buckets=8)
    runs.upsert(decided, 1)
    queued = journal.pending_fills(runs.rows().drop(VERSION))
    short = journal.records(runs.rows()).filter(F.col("proposal.side") == "short").select("run_id")
    closed = {"status": F.lit("filled_sim"), "fill_price": F.lit(0.5), "exit_status": F.lit("stop")}
    fills = BucketedTable(spark, fresh_path(spark, "x4-fills"), "run_id", buckets=8)
    fills.upsert(queued.join(short, "run_id", "left_semi").withColumns(closed), 1)
    slices = [queued.filter(F.col("line") % 2 == 0), queued.filter(F.col("line") % 2 == 1), queued]
    checkpoint = fresh_path(spark, "x4-checkpoint")
    for arrived in arrivals(spark, slices, "x4-in"):
        stream_fills(arrived, lambda keys: runs.rows_for(keys).drop(VERSION), fills, checkpoint, after=1).awaitTermination()
    return out(fills.rows().select("run_id", "status", "fill_price", "exit_status", F.col(VERSION).alias("version")))


@query("x5_stream_trades", outer("taken", """instrument, entry_idx, epoch(entry_ts)::BIGINT AS entry_ts, side, round(entry, 6) AS entry, exit_idx,
    epoch(exit_ts)::BIGINT AS exit_ts, round(exit_price, 6) AS exit_price, exit_status, r_realized""") + " WHERE exit_status <> 'window_end'")
def stream_trades_query(spark, sf):
    """Decided bars in four slices of time; tickets stay open over the seams."""
    ticket = lambda c: F.when(F.col("risk.action") == "pending_exec", F.col(f"proposal.{c}")).alias(c)
    decided = outcomes.decide(hourly_labels(spark, sf), PAPER).select(
        *KEYS, "idx", "ts", "high", "low", "close", *[ticket(c) for c in ("side", "play_class", "entry", "stop", "target")]
    ).persist()
    low, high = decided.agg(F.min("idx"), F.max("idx")).first()
    slices = [decided.filter(F.floor((F.col("idx") - low) * 4 / (high - low + 1)) == i) for i in range(4)]
    root, checkpoint = fresh_path(spark, "x5"), fresh_path(spark, "x5-checkpoint")
    for arrived in arrivals(spark, slices, "x5-in"):
        stream_trades(arrived, KEYS, root, checkpoint).awaitTermination()
    trades = spark.read.parquet(f"{root}/closed").drop("batch")
    return out(trades, "instrument", "entry_idx", "entry_ts", "side", "entry", "exit_idx", "exit_ts", "exit_price", "exit_status", "r_realized")
