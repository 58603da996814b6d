"""Text scalars: whitespace, slugs, topics, prefixes, HTML to text, model output."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from candlewick.functions.numbers import is_true

# Fixed value: whitespace as the text pipeline counts it (Unicode spaces and separators).
SPACE = r"(?U)[\s\x1c-\x1f]"
PREVIEW_CHARS = 200
EXCERPT_CHARS = 800

# Words accepted as confidence.
CONFIDENCE_WORDS = {
    "high": 0.8, "strong": 0.8, "medium": 0.5, "moderate": 0.5, "mid": 0.5, "low": 0.2, "weak": 0.2, "none": 0.0,
}

# Query text per formation stage.
STAGE_QUERIES = {
    "none": "trendline support resistance early formation",
    "left_shoulder": "head and shoulders left shoulder formation early",
    "head": "head and shoulders head formation volume",
    "right_shoulder_forming": "head and shoulders right shoulder volume dull rally",
    "neckline_tentative": "tentative neckline head and shoulders confirmation volume",
    "confirmed_break": "head and shoulders neckline break measurement objective",
    "invalidated": "head and shoulders failed false confirmation",
}
OTHER_STAGE_QUERY = "head and shoulders reversal neckline"

# Fixed value: the query template of a regime row (regime, direction, plays).
REGIME_QUERY = "Kathy Lien %s %s %s currency market regime filter strategy"


def strip(text: Column) -> Column:
    """Trim whitespace of every kind at both ends."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE.replace('(?U)', '')}+", "")


def words(text: Column) -> Column:
    """Whitespace-delimited tokens, none empty."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), r"(?U)[^\w\-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit("document"))


def join_topics(topics: Column) -> Column:
    """List of topics to comma text, trimmed, empties dropped."""
    return F.array_join(F.filter(F.transform(topics, strip), lambda t: t != ""), ",")


def context_prefix(source: Column, author: Column, asset_class: Column, topics: Column) -> Column:
    """``[source | author | asset_class | topics: ...]`` with missing parts left out."""
    present = lambda c: F.nullif(c, F.lit(""))
    body = F.concat_ws(" | ", source, present(author), present(asset_class), F.concat(F.lit("topics: "), present(topics)))
    return F.concat(F.lit("["), body, F.lit("]"))


def prefixed(text: Column, prefix: Column) -> Column:
    return F.concat(prefix, F.lit("\n"), text)


def chunk_id(source: Column, index: Column) -> Column:
    return F.concat(source, F.lit("::"), index.cast("string"))


def figure_id(source: Column, page: Column, figure_index: Column) -> Column:
    return F.format_string("%s::fig::p%04d::%d", source, page, figure_index)


def figure_text(page: Column, caption: Column, nearby: Column) -> Column:
    snippet = F.nullif(strip(F.coalesce(nearby, F.lit(""))), F.lit(""))
    return F.concat(
        F.lit("[Figure page "), page.cast("string"), F.lit("] "), strip(caption),
        F.coalesce(F.concat(F.lit("\n\nNearby text: "), snippet), F.lit("")),
    )


def preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(head)


def regime_query(regime: Column, way: Column, plays: Column) -> Column:
    return strip(
        F.format_string(
            REGIME_QUERY,
            F.coalesce(regime, F.lit("mixed")), F.coalesce(way, F.lit("")), F.array_join(plays, ", "),
        )
    )


def stage_query(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STAGE_QUERIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, stage), F.lit(OTHER_STAGE_QUERY))


# HTML -------------------------------------------------------------------------

_BREAK = "\x01"


# Numeric references to these control codes mean the characters that Windows puts there.
_WINDOWS = {c: bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0xA0)}
# Names that need no semicolon, the longest first.
_BARE_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def _decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once; the old names need no semicolon."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    windows = F.create_map(*[F.lit(x) for c, char in _WINDOWS.items() if char for x in (c, char)])

    def decode(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^&#(?:\d+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_extract(number, r"^&#[xX]?0*([0-9a-fA-F]+)", 1)
        short = F.when(F.length(digits) <= 9, digits)  # longer ones are no characters
        code = F.when(number.rlike("[xX]"), F.conv(short, 16, 10)).otherwise(short).try_cast("bigint")
        allowed = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(is_true(allowed), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        closed = F.regexp_extract(piece, r"^&(\w+;)", 1)
        bare = F.regexp_extract(piece, "^&(" + "|".join(_BARE_NAMES) + ")", 1)
        name = F.when(F.try_element_at(named, closed).isNotNull(), closed).otherwise(bare)
        return (
            F.when(number != "", F.concat(F.coalesce(F.try_element_at(windows, code.try_cast("int")), char), F.substring(piece, F.length(number) + 1, F.length(piece))))
            .when(name != "", F.concat(F.try_element_at(named, name), F.substring(piece, F.length(name) + 2, F.length(piece))))
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.split(text, "(?=&)"), decode), "")


def html_to_text(html: Column) -> Column:
    """Text nodes joined by newlines, each stripped; scripts, styles and comments dropped, also unclosed ones.

    A tag ends at the first ``>`` outside quotes, or at the first one where a quote
    is never closed.
    """
    bare = html
    for pattern in (r"(?is)<(script|style)(?:[\t\n\f\r /][^>]*)?>.*?(?:</\1\s*>|\z)", r"(?s)<!--.*?(?:-->|\z)"):
        bare = F.regexp_replace(bare, pattern, _BREAK)
    quoted = r"""<[/!?]?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[/!?]?[A-Za-z][^>]*>"""
    broken = F.regexp_replace(bare, quoted, _BREAK)
    nodes = F.transform(F.split(broken, _BREAK), lambda t: strip(F.when(t.contains("&"), _decode_entities(t)).otherwise(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), "\n")


# Model output -------------------------------------------------------------------


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def json_object(text: Column) -> Column:
    """JSON object text inside model output: fenced, whole, or between the outer braces; else null."""
    cleaned = strip_think(text)
    pieces = F.split(cleaned, "```")
    # Every second piece stands inside a fence; the last one only if its fence is closed.
    inside = F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & (i < F.size(pieces) - 1), strip(F.regexp_replace(p, "^json", ""))))
    fenced = F.get(F.filter(inside, lambda p: p.startswith("{") & p.endswith("}")), 0)
    body = F.coalesce(fenced, cleaned)
    opened, closed = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
    braces = F.when((opened > 0) & (closed > opened), F.substring(body, opened, closed - opened + 1))
    is_object = lambda t: F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT")
    return F.when(is_object(body), body).when(is_object(braces), braces)


def _variant_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def variant_text(value: Column) -> Column:
    """Text of a JSON value: lists joined with ``; ``, null as empty."""
    kind = _variant_type(value)
    items = F.try_variant_get(value, "$", "array<string>")
    return (
        F.when(value.isNull() | (kind == "VOID"), "")
        .when(kind.startswith("ARRAY"), F.array_join(items, "; ", "None"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def variant_confidence(value: Column) -> Column:
    """Confidence in [0, 1] from a number, a word, a percent text or a flag."""
    kind = _variant_type(value)
    text = F.rtrim(F.lower(strip(F.try_variant_get(value, "$", "string"))), F.lit("%"))
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    typed = text.try_cast("double")
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    from_text = F.coalesce(
        F.try_element_at(table, text), clamp(F.when((typed > 1) & (typed <= 100), typed / 100).otherwise(typed)), F.lit(0.0)
    )
    return (
        F.when(value.isNull() | (kind == "VOID"), 0.0)
        .when(kind == "STRING", from_text)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), 1.0).otherwise(0.0))
        .otherwise(F.coalesce(clamp(F.try_variant_get(value, "$", "double")), F.lit(0.0)))
    )


def compact_symbol(instrument: Column) -> Column:
    """``GBP_USD`` and ``gbp/usd`` to ``GBPUSD``."""
    return F.upper(strip(F.regexp_replace(instrument, "[_/]", "")))
