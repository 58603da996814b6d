"""Time scalars: RFC3339 parsing and formatting, granularities, clock offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from candlewick.functions.text import strip

# Bar granularities in seconds.
GRANULARITY_SECONDS = {
    "S5": 5, "S10": 10, "S15": 15, "S30": 30,
    "M1": 60, "M5": 300, "M15": 900, "M30": 1800,
    "H1": 3600, "H2": 7200, "H3": 10800, "H4": 14400, "H6": 21600, "H8": 28800, "H12": 43200,
    "D": 86400, "W": 604800, "M": 2592000,
}

# Granularity -> chart period name and minutes.
CHART_PERIODS = {
    "M1": ("M1", 1), "M5": ("M5", 5), "M15": ("M15", 15), "M30": ("M30", 30),
    "H1": ("H1", 60), "H4": ("H4", 240),
    "D": ("D1", 1440), "D1": ("D1", 1440),
    "W": ("W1", 10080), "W1": ("W1", 10080),
    "MN": ("MN1", 43200), "MN1": ("MN1", 43200),
}


def well_formed(text: Column) -> Column:
    """Whether text has the shape of an RFC3339 time: to the second, then a fraction and a zone if any."""
    shape = F.translate(text, "123456789", "000000000")
    rest = F.substring(shape, F.lit(20), F.greatest(F.length(shape) - 19, F.lit(0)))
    fraction = F.regexp_extract(rest, r"^\.0+", 0)
    zone = F.substring(rest, F.length(fraction) + 1, F.length(rest))
    return (F.substring(shape, 1, 19) == "0000-00-00T00:00:00") & zone.isin("", "Z", "+00:00", "-00:00")


def parse_instant(text: Column) -> Column:
    """RFC3339 text (up to nanoseconds) to a microsecond timestamp; null on junk."""
    return F.try_to_timestamp(F.nullif(strip(text), F.lit("")))


def parse_seconds(text: Column) -> Column:
    """RFC3339 text to whole UTC seconds; null on junk."""
    return F.unix_seconds(parse_instant(text))


def shift_instant(ts: Column, micros: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(micros))


def format_instant(ts: Column) -> Column:
    """UTC text with nine fractional digits."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def compare_instants(left: Column, right: Column) -> Column:
    """-1, 0 or 1; text order when either side does not parse; 0 when either is missing."""

    def side(a: Column, b: Column) -> Column:
        return (a > b).cast("int") - (a < b).cast("int")  # null when either is

    as_text = [F.nullif(x, F.lit("")) for x in (left, right)]
    return F.coalesce(side(parse_instant(left), parse_instant(right)), side(*as_text), F.lit(0))


def instant_key(text: Column) -> Column:
    """A canonical key: equal instants give equal keys, unparseable text stands for itself."""
    return F.coalesce(format_instant(parse_instant(text)), text, F.lit(""))


def feed_seconds(ts: Column, offset_seconds: Column | int = 0) -> Column:
    """Epoch seconds on a feed's own clock."""
    offset = F.lit(offset_seconds) if isinstance(offset_seconds, int) else offset_seconds
    return F.unix_seconds(ts) + offset.cast("bigint")


def clock_offset(explicit: Column, current: Column, gmt: Column) -> Column:
    """Explicit offset, else current minus GMT, else 0."""
    return F.coalesce(explicit, current - gmt, F.lit(0)).cast("bigint")


def chart_period(granularity: Column) -> Column:
    """Struct (name, minutes); null when the granularity is unknown."""
    key = F.upper(strip(granularity))
    names = F.create_map(*[F.lit(x) for k, v in CHART_PERIODS.items() for x in (k, v[0])])
    minutes = F.create_map(*[F.lit(x) for k, v in CHART_PERIODS.items() for x in (k, v[1])])
    return F.when(
        F.try_element_at(names, key).isNotNull(),
        F.struct(F.try_element_at(names, key).alias("name"), F.try_element_at(minutes, key).alias("minutes")),
    )


def chart_period_problem(granularity: Column) -> Column:
    """Why a granularity has no chart period; null when it has one."""
    names = ", ".join(f"'{k}'" for k in sorted(CHART_PERIODS))
    text = F.concat(F.lit("Unsupported timeframe '"), F.coalesce(granularity, F.lit("")), F.lit(f"'; expected one of [{names}]."))
    return F.when(chart_period(granularity).isNull(), text)


def granularity_problem(granularity: Column) -> Column:
    """Why a request's granularity is refused; null when it is fine."""
    known = F.upper(strip(F.coalesce(granularity, F.lit("")))).isin(*GRANULARITY_SECONDS)
    return F.when(~known, F.concat(F.lit("unsupported granularity '"), F.coalesce(granularity, F.lit("")), F.lit("'")))


def time_problem(text: Column) -> Column:
    """Why a request's time is refused; null when it is fine or left blank."""
    given = F.nullif(strip(text), F.lit(""))
    return F.when(given.isNotNull() & ~well_formed(given), "must be RFC3339 (e.g. 2024-01-01T00:00:00Z)")


def ticket_stamp(text: Column) -> Column:
    """Readable UTC stamp of RFC3339 text, to the second."""
    plain = F.split_part(F.replace(F.regexp_replace(strip(text), "Z$", ""), F.lit("T"), F.lit(" ")), F.lit("+"), F.lit(1))
    return F.when(strip(text) == "", "").otherwise(F.concat(F.substring(plain, 1, 19), F.lit(" UTC")))


def ticket_stamp_seconds(seconds: Column) -> Column:
    """Readable UTC stamp of epoch seconds, to the minute."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm 'UTC'")


def bar_start(ts: Column, granularity: str) -> Column:
    """Start of the bar holding ``ts``; weeks start on Monday, months on day one."""
    if granularity == "W":
        return F.date_trunc("week", ts)
    if granularity == "M":
        return F.date_trunc("month", ts)
    width = GRANULARITY_SECONDS[granularity]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)
