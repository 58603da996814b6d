"""Model answers to validated proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.numbers import computed_once, is_true
from candlewick.functions.text import json_object, variant_confidence, variant_text

# Allowed enumerations, side synonyms and the default thesis.
PLAY_CLASSES = ("join_trend", "fade_range", "breakout_watch")
SIDES = ("long", "short", "none")
SIDE_SYNONYMS = {"buy": "long", "sell": "short"}
MISSING_THESIS = "model omitted thesis"


def _text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parse_proposals(answers: DataFrame, text: str, allowed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a ``proposal`` struct, rejected rows with ``reason``).

    Lists in text fields are joined, confidence is coerced to [0, 1], citations
    without source or index are dropped, missing play and thesis get defaults.
    """
    parsed = computed_once(computed_once(answers, "_json", json_object(F.col(text))), "_v", F.try_parse_json("_json"))
    get = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
    play = F.coalesce(
        F.nullif(_text_of(F.col("_v"), "$.play_class"), F.lit("")),
        F.try_element_at(F.filter(F.col(allowed), lambda p: p != ""), F.lit(1)),
        F.lit("breakout_watch"),
    )
    raw_side = F.coalesce(F.nullif(_text_of(F.col("_v"), "$.side"), F.lit("")), F.lit("none"))
    synonyms = F.create_map(*[F.lit(x) for pair in SIDE_SYNONYMS.items() for x in pair])
    side = F.coalesce(F.try_element_at(synonyms, F.lower(raw_side)), raw_side)
    cited = F.coalesce(F.try_variant_get(F.col("_v"), "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    cites = F.filter(
        F.transform(
            cited,
            lambda c: F.struct(
                _text_of(c, "$.source").alias("source"),
                F.try_variant_get(c, "$.chunk_index", "int").alias("chunk_index"),
                F.try_variant_get(c, "$.distance", "double").alias("distance"),
            ),
        ),
        lambda c: c["source"].isNotNull() & c["chunk_index"].isNotNull(),
    )
    price = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "double")
    bad_price = F.array_compact(
        F.array(
            *[
                F.when(price(c).isNull() & _text_of(F.col("_v"), f"$.{c}").isNotNull(), c)
                for c in ("entry", "stop", "target")
            ]
        )
    )
    shaped = parsed.withColumns(
        {
            "proposal": F.struct(
                F.coalesce(F.nullif(variant_text(get("thesis")), F.lit("")), F.lit(MISSING_THESIS)).alias("thesis"),
                play.alias("play_class"),
                side.alias("side"),
                *[price(c).alias(c) for c in ("entry", "stop", "target")],
                _text_of(F.col("_v"), "$.at_time").alias("at_time"),
                variant_confidence(get("confidence")).alias("confidence"),
                cites.alias("citations"),
                variant_text(get("notes")).alias("notes"),
            ),
            "_bad_price": bad_price,
        }
    )
    reason = (
        F.when(F.col("_json").isNull(), "model output is not a JSON object")
        .when(~F.col("proposal.play_class").isin(*PLAY_CLASSES), "proposal failed validation: play_class")
        .when(~F.col("proposal.side").isin(*SIDES), "proposal failed validation: side")
        .when(is_true(F.size("_bad_price") > 0), F.concat(F.lit("proposal failed validation: "), F.array_join("_bad_price", ", ")))
    )
    marked = computed_once(shaped, "reason", reason).drop("_json", "_v", "_bad_price")
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull()).drop("proposal")
