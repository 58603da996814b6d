"""Chat formatting of typed content parts, in DataFrame functions only.

A turn is a list of parts: text, image, audio or document. A visitor renders each part
in order (escaped text, or a placeholder), records what the placeholders refer to and
how many tokens they expand to, and the turns of a conversation are joined under one
template. Inside texts and roles a backslash stands before every backslash and every
bar, so no control string can be written there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens one unit of an attachment expands to: an image's tile, a second of sound, a document's page.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 640.0}
PART = "struct<kind: string, text: string, ref: string, units: double>"


def escaped(text: Column) -> Column:
    slashes = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashes, F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def placeholder(kind: str) -> str:
    return f"<|{kind}|>"


def text_part(text: Column) -> Column:
    """One text part holding a whole text; null is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _visit(part: Column, tokens_per_unit: dict[str, float]) -> Column:
    """What a part is written as; an unknown or null kind is written as its text."""
    rendered = escaped(part["text"])
    for kind in tokens_per_unit:
        rendered = F.when(part["kind"] == kind, F.lit(placeholder(kind))).otherwise(rendered)
    return rendered


def _attachments(parts: Column, tokens_per_unit: dict[str, float]) -> Column:
    def record(part: Column) -> Column:
        rate = F.lit(0.0)
        for kind, tokens in tokens_per_unit.items():
            rate = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(rate)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).alias("tokens"))

    return F.transform(F.filter(parts, lambda p: p["kind"].isin(*tokens_per_unit)), record)


def format_conversations(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",), tokens_per_unit: dict[str, float] | None = None,
) -> DataFrame:
    """One row per conversation: formatted, turn_starts, loss_spans, attachments, expanded_tokens.

    Turns are ordered by number, null first; equal numbers by role, then by what is
    written, so repeated rows stay and the order is defined. A null role or part list is
    empty; turns with a null conversation form one. ``loss_spans`` are (turn, start,
    length) in code points of ``formatted`` and cover what the loss roles say;
    ``attachments`` stand in the order of their placeholders. Other columns are not read.
    """
    rates = TOKENS_PER_UNIT if tokens_per_unit is None else tokens_per_unit
    given = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    said = F.coalesce(F.col(role), F.lit(""))
    written = turns.select(
        F.col(conversation).alias("__conv"), F.col(turn).alias("__turn"), said.alias("__role"),
        F.array_join(F.transform(given, lambda p: _visit(p, rates)), "").alias("__body"), _attachments(given, rates).alias("__refs"),
    )
    head = F.concat(F.lit(OPEN), escaped(F.col("__role")), F.lit(MIDDLE))
    segments = written.withColumns({"__head": F.length(head), "__segment": F.concat(head, "__body", F.lit(CLOSE))})
    order = Window.partitionBy("__conv").orderBy(F.col("__turn").asc_nulls_first(), "__role", "__body")
    before = F.sum(F.length("__segment")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ordered = segments.withColumns({"__at": F.row_number().over(order) - 1, "__start": F.coalesce(before, F.lit(0)).cast("long")})
    spoken = F.struct("__at", "__segment", "__start", "__head", F.length("__body").cast("long").alias("__length"), F.col("__role").isin(*loss_roles).alias("__trained"), "__refs")
    joined = ordered.groupBy("__conv").agg(F.array_sort(F.collect_list(spoken)).alias("__turns"))
    spans = F.transform(F.filter("__turns", lambda t: t["__trained"]), lambda t: F.struct(t["__at"].alias("turn"), (t["__start"] + t["__head"]).alias("start"), t["__length"].alias("length")))
    attachments = F.flatten(F.transform("__turns", lambda t: t["__refs"]))
    return joined.select(
        F.col("__conv").alias(conversation),
        F.array_join(F.transform("__turns", lambda t: t["__segment"]), "").alias("formatted"),
        F.transform("__turns", lambda t: t["__start"]).alias("turn_starts"),
        spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("expanded_tokens"),
    )


def without_placeholders(text: Column, kinds: tuple[str, ...] = tuple(TOKENS_PER_UNIT)) -> Column:
    return F.regexp_replace(text, "<\\|(" + "|".join(kinds) + ")\\|>", "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both read from the formatted string alone and its spans."""
    pieces = F.split("formatted", "<\\|im_start\\|>")
    kept = formatted.withColumn("__pieces", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def parsed(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(1), F.length(piece) - len(CLOSE)), "<\\|im_sep\\|>")
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(without_placeholders(halves[1])).alias("text"))

    def masked(span: Column) -> Column:
        at = span["start"] - F.element_at("turn_starts", span["turn"] + 1) - len(OPEN) + 1
        return unescaped(without_placeholders(F.substring(F.element_at("__pieces", span["turn"] + 1), at.cast("int"), span["length"].cast("int"))))

    return kept.select(
        *formatted.columns, F.transform("__pieces", parsed).alias("turns"), F.array_join(F.transform("loss_spans", masked), "").alias("loss_text")
    )
