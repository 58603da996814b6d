"""Document manifest: defaults, ingest plan and ingest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.text import join_topics

DEFAULTED = ("title", "author", "asset_class", "evidence_level", "acquisition")


def apply_defaults(entries: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fill blank fields from the manifest defaults; a topics list becomes comma text."""
    def value(column: str) -> Column:
        own = F.nullif(F.col(column), F.lit("")) if column in entries.columns else F.lit(None).cast("string")
        return F.coalesce(own, F.lit(defaults.get(column)).cast("string"))

    out = entries.withColumns({c: value(c) for c in DEFAULTED})
    if dict(entries.dtypes).get("topics", "").startswith("array"):
        out = out.withColumn("topics", join_topics(F.col("topics")))
    return out


def latest_state(state: DataFrame) -> DataFrame:
    """The last recorded counts per source of an append-only state table."""
    fields = [c for c in state.columns if c not in ("source_id", "batch")]
    return state.groupBy("source_id").agg(*[F.max_by(c, "batch").alias(c) for c in fields])


def state_rows(chunks: DataFrame, batch: int) -> DataFrame:
    """State rows for freshly ingested sources."""
    kinds = chunks.groupBy(F.col("source").alias("source_id")).agg(
        F.count_if(F.col("chunk_type") == "text").alias("chunks_added"),
        F.count_if(F.col("chunk_type") == "figure").alias("figures_added"),
    )
    return kinds.withColumn("batch", F.lit(batch).cast("bigint"))


def plan_ingest(
    entries: DataFrame, files: DataFrame, state: DataFrame | None = None, only: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(entries to ingest, entries whose file is missing): enabled, wanted, not ingested yet."""
    wanted = entries.filter(F.coalesce("enabled", F.lit(True)))
    if only:
        wanted = wanted.filter(F.col("source_id").isin(*only))
    if state is not None:
        wanted = wanted.join(state.select("source_id").distinct(), "source_id", "left_anti")
    listed = files.select("file").distinct()
    return wanted.join(listed, "file", "left_semi"), wanted.join(listed, "file", "left_anti")
