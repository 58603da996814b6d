"""Sources, cleaning, windows and time scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions import times
from candlewick.functions.text import compact_symbol, join_topics, slug
from candlewick.functions.tickets import merge_notes
from candlewick.operators.series import first_index
from candlewick.plans.catalog.inputs import KEYS, daily, hourly, hourly_ticks, out, outer, sql, table
from candlewick.plans.registry import query
from candlewick.sources import candles

BAR = ("instrument", "ts", "open", "high", "low", "close", "volume")
_BAR_SQL = "instrument, epoch(ts)::BIGINT AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query("s5_hourly_bars", outer("hb", _BAR_SQL + ", idx"))
def hourly_bars(spark, sf):
    return out(hourly(spark, sf), *BAR, "idx")


@query("s5_daily_supplier_bars", outer("db", _BAR_SQL.replace(", 6)", ", 9)") + ", idx"))
def daily_bars(spark, sf):
    return out(daily(spark, sf), *BAR, "idx", digits=9)


@query("s5_weekly_bars", """
    SELECT instrument, epoch(ts)::BIGINT AS ts, open, high, low, close, volume FROM (
        SELECT event_type AS instrument, date_trunc('week', ts) AS ts, first(value ORDER BY events.ts, event_id) AS open,
            max(value) AS high, min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, count(*) AS volume
        FROM events GROUP BY 1, 2)""")
def weekly_bars(spark, sf):
    events = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return out(candles.bars_from_ticks(events, F.col("event_type"), "W", ts, F.col("value"), F.col("event_id")), *BAR)


def _payloads(spark, sf):
    """One JSON page per series and day; some candles lack mid or every price."""
    price = lambda shift: F.struct(
        *[(F.col(c) - shift).cast("string").alias(n) for c, n in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))]
    )
    bars = hourly_ticks(spark, sf)
    candle = F.struct(
        times.format_instant(F.col("ts")).alias("time"),
        (F.col("volume") % 5 != 0).alias("complete"),
        "volume",
        F.when(F.col("volume") % 3 != 0, price(0.0)).alias("mid"),
        F.when(F.col("volume") % 7 != 0, price(0.5)).alias("bid"),
    )
    pages = bars.groupBy("instrument", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", candle.alias("c")))).alias("_c"))
    return pages.select("instrument", F.to_json(F.struct(F.col("_c.c").alias("candles"))).alias("payload"))


@query("s1_candles_from_json", outer("hb", """instrument, epoch(ts)::BIGINT AS ts,
    round(open - CASE WHEN volume % 3 <> 0 THEN 0.0 ELSE 0.5 END, 6)::DOUBLE AS open,
    round(close - CASE WHEN volume % 3 <> 0 THEN 0.0 ELSE 0.5 END, 6)::DOUBLE AS close, volume, volume % 5 <> 0 AS complete""")
    + " WHERE NOT (volume % 3 = 0 AND volume % 7 = 0)")
def candles_from_json(spark, sf):
    bars = candles.parse_payloads(_payloads(spark, sf), "payload", ["instrument"])
    return out(bars, "instrument", "ts", "open", "close", "volume", "complete")


def _pages(spark, sf):
    """Two overlapping page dumps; the second repeats every bar with another volume."""
    bars = hourly_ticks(spark, sf).withColumn("time", times.format_instant(F.col("ts")))
    return bars.withColumn("page", F.lit(1)).unionByName(bars.withColumn("page", F.lit(2)).withColumn("volume", F.col("volume") + 1000))


@query("s2_merged_pages", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS r FROM hb WHERE ts <= TIMESTAMP '2024-01-20 00:00:00')
    WHERE r <= 300""", "hb"))
def merged_pages(spark, sf):
    merged = candles.merge_pages(_pages(spark, sf), KEYS, ["page"], _at("2024-01-20 00:00:00"), 300)
    return out(merged, "instrument", "ts", "close", "volume")


@query("s3_latest_bars", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS r FROM hb WHERE ts <= TIMESTAMP '2024-01-25 00:00:00')
    WHERE r <= 200""", "hb"))
def latest_bars(spark, sf):
    return out(candles.latest_bars(hourly_ticks(spark, sf), KEYS, 200, _at("2024-01-25 00:00:00")), "instrument", "ts", "close")


@query("s4_bars_from_count", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS r FROM hb WHERE ts >= TIMESTAMP '2024-01-05 00:00:00')
    WHERE r <= 150""", "hb"))
def bars_from_count(spark, sf):
    chosen = candles.select_bars(hourly_ticks(spark, sf), KEYS, frm=_at("2024-01-05 00:00:00"), count=150)
    return out(chosen, "instrument", "ts", "close")


@query("s4_bars_in_range", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close FROM hb
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""", "hb"))
def bars_in_range(spark, sf):
    chosen = candles.select_bars(hourly_ticks(spark, sf), KEYS, _at("2024-01-05 00:00:00"), _at("2024-01-15 00:00:00"))
    return out(chosen, "instrument", "ts", "close")


@query("s4_default_window", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS r FROM hb) WHERE r <= 100""", "hb"))
def default_window(spark, sf):
    return out(candles.select_bars(hourly_ticks(spark, sf), KEYS), "instrument", "ts", "close")


@query("f1_f2_f4_f5_prepared_bars", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close, volume FROM hb
    WHERE volume % 5 <> 0 AND ts <= TIMESTAMP '2024-01-28 00:00:00'""", "hb"))
def prepared_bars(spark, sf):
    dumped = _pages(spark, sf).withColumn("complete", F.when(F.col("volume") % 7 != 0, F.col("volume") % 5 != 0))
    dumped = dumped.withColumn("complete", F.when((F.col("page") == 2) | (F.col("volume") % 5 == 0), F.col("volume") % 5 != 0).otherwise(F.col("complete")))
    ready = candles.prepare_bars(dumped, KEYS, "time", ["page"], _at("2024-01-28 00:00:00"))
    return out(ready, "instrument", "ts", "close", "volume")


@query("f3_first_index", sql("SELECT instrument, min(idx) AS start_idx FROM hb WHERE ts >= TIMESTAMP '2024-01-10 00:30:00' GROUP BY 1", "hb"))
def first_index_query(spark, sf):
    return out(first_index(hourly(spark, sf), KEYS, _at("2024-01-10 00:30:00")), "instrument", "start_idx")


@query("f6_invalid_bars", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts,
    CASE WHEN volume % 9 = 0 THEN 'missing ''open''' ELSE 'high < low' END AS reason FROM hb
    WHERE volume % 9 = 0 OR (volume % 4 = 0 AND high > low)""", "hb"))
def invalid_bars(spark, sf):
    broken = hourly_ticks(spark, sf).withColumns(
        {
            "open": F.when(F.col("volume") % 9 != 0, F.col("open")),
            "high": F.when(F.col("volume") % 4 == 0, F.col("low")).otherwise(F.col("high")),
            "low": F.when(F.col("volume") % 4 == 0, F.col("high")).otherwise(F.col("low")),
        }
    )
    return out(candles.split_valid(broken)[1], "instrument", "ts", "reason")


@query("f7_walk_range", sql("""SELECT instrument, epoch(ts)::BIGINT AS ts, close FROM (
    SELECT *, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') OVER (PARTITION BY instrument) AS n FROM hb)
    WHERE idx >= n - 120 AND ts <= TIMESTAMP '2024-01-22 00:00:00'""", "hb"))
def walk_range(spark, sf):
    chosen = candles.walk_range(hourly_ticks(spark, sf), KEYS, _at("2024-01-15 00:00:00"), _at("2024-01-22 00:00:00"), 120)
    return out(chosen, "instrument", "ts", "close")


@query("f10_instrument_syntax", """
    SELECT reason, count(*) AS n FROM (
        SELECT 'instrument must look like GBP_USD' AS reason FROM events UNION ALL SELECT NULL FROM lineitem) GROUP BY 1""")
def instrument_syntax(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("instrument")).unionByName(
        table(spark, sf, "lineitem").select(F.concat(F.lit("SUP_"), F.col("l_suppkey").cast("string")).alias("instrument"))
    )
    return out(names.groupBy(candles.instrument_problem(F.col("instrument")).alias("reason")).agg(F.count("*").alias("n")))


@query("f10_request_rules", """
    SELECT granularity_reason, time_reason, source_reason, period_reason, count(*) AS n FROM (SELECT
        CASE user_id % 4 WHEN 0 THEN 'unsupported granularity ''m7''' WHEN 3 THEN 'unsupported granularity ''''' END AS granularity_reason,
        CASE WHEN event_id % 3 = 1 THEN 'must be RFC3339 (e.g. 2024-01-01T00:00:00Z)' END AS time_reason,
        CASE WHEN event_id % 2 = 0 THEN 'source must be alphanumeric, underscore, or hyphen' END AS source_reason,
        CASE WHEN user_id % 4 <> 2 THEN 'Unsupported timeframe ''' || CASE user_id % 4 WHEN 0 THEN 'm7' WHEN 1 THEN ' s5' ELSE '' END
            || '''; expected one of [''D'', ''D1'', ''H1'', ''H4'', ''M1'', ''M15'', ''M30'', ''M5'', ''MN'', ''MN1'', ''W'', ''W1''].' END AS period_reason
        FROM events) GROUP BY ALL""")
def request_rules(spark, sf):
    """Requests made of the events: good and bad granularities, times and sources, and chart periods that do not exist."""
    user, event = F.col("user_id") % 4, F.col("event_id")
    granularity = F.when(user == 0, "m7").when(user == 1, " s5").when(user == 2, "h4 ")
    time = times.format_instant(F.col("ts").cast("timestamp"))
    asked = F.when(event % 3 == 0, time).when(event % 3 == 1, F.replace(time, F.lit("T"), F.lit(" "))).otherwise(" ")
    source = F.when(event % 2 == 0, F.concat("event_type", F.lit("/x"))).otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").select(
        times.granularity_problem(granularity).alias("granularity_reason"), times.time_problem(asked).alias("time_reason"),
        candles.source_problem(source).alias("source_reason"), times.chart_period_problem(granularity).alias("period_reason"),
    )
    return out(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))


@query("d1_d2_d3_times", """
    SELECT event_id, epoch_us(ts) // 1000000 AS seconds,
        strftime(ts - INTERVAL 1 MICROSECOND, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS just_before,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS key,
        CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN -1 ELSE 1 END::BIGINT AS side,
        epoch_us(ts) // 1000000 + 7200 AS feed, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS stamp,
        strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS short_stamp, true AS no_junk, true AS well_formed
    FROM events""")
def time_scalars(spark, sf):
    ts = F.col("ts").cast("timestamp")
    text = F.col("text")
    rows = table(spark, sf, "events").select("event_id", times.format_instant(ts).alias("text"))
    instant = times.parse_instant(text)
    return out(
        rows.select(
            "event_id",
            times.parse_seconds(text).alias("seconds"),
            times.format_instant(times.shift_instant(instant, -1)).alias("just_before"),
            times.instant_key(text).alias("key"),
            times.compare_instants(text, F.lit("2024-01-15T14:00:00.0+02:00")).alias("side"),
            times.feed_seconds(instant, 7200).alias("feed"),
            times.ticket_stamp(text).alias("stamp"),
            times.ticket_stamp_seconds(times.parse_seconds(text)).alias("short_stamp"),
            times.parse_instant(F.concat(F.lit("x"), text)).isNull().alias("no_junk"),
            times.well_formed(text).alias("well_formed"),
        )
    )


@query("d4_d5_symbols", """
    SELECT event_type || '_' || (user_id % 10) AS instrument, upper(event_type) || (user_id % 10) AS symbol,
        CASE user_id % 4 WHEN 0 THEN 'D1' WHEN 1 THEN 'H4' WHEN 2 THEN 'W1' END AS period,
        CASE user_id % 4 WHEN 0 THEN 1440 WHEN 1 THEN 240 WHEN 2 THEN 10080 END::BIGINT AS minutes, count(*) AS n
    FROM events GROUP BY ALL""")
def symbols(spark, sf):
    gran = F.element_at(F.array(F.lit(" d"), F.lit("h4 "), F.lit("W"), F.lit("S5")), (F.col("user_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("instrument"), gran.alias("g")
    )
    period = times.chart_period(F.col("g"))
    shaped = rows.select("instrument", compact_symbol(F.col("instrument")).alias("symbol"), period["name"].alias("period"), period["minutes"].alias("minutes"))
    return out(shaped.groupBy("instrument", "symbol", "period", "minutes").agg(F.count("*").alias("n")))


@query("d6_slugs", r"""
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{M}\p{N}\p{Pc}\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'document') AS slug
    FROM pages""")
def slugs(spark, sf):
    return out(table(spark, sf, "pages").select("page_id", slug(F.col("url")).alias("slug")))


@query("d7_d9_topics_and_notes", """
    SELECT doc_id, source || ',' || lang AS topics, CASE WHEN lang = 'en' THEN source || '; checked' ELSE 'checked' END AS notes
    FROM documents""")
def topics_and_notes(spark, sf):
    docs = table(spark, sf, "documents")
    listed = F.array(F.concat(F.lit(" "), F.col("source")), F.lit("  "), F.concat(F.col("lang"), F.lit("\n")))
    existing = F.when(F.col("lang") == "en", F.concat(F.col("source"), F.lit(" ")))
    return out(docs.select("doc_id", join_topics(listed).alias("topics"), merge_notes(existing, F.lit("checked")).alias("notes")))


@query("d10_clock_offset", """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 3600 WHEN user_id % 3 = 1 THEN 7200 ELSE 0 END::BIGINT AS shift FROM events""")
def clock_offset(spark, sf):
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("user_id") % 3
    offset = times.clock_offset(F.when(kind == 0, 3600), F.when(kind != 2, now + 7200), now)
    return out(table(spark, sf, "events").select("event_id", offset.alias("shift")))
