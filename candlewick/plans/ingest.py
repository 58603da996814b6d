"""Ingest a manifest of documents into a versioned chunk table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from candlewick.operators.corpus import ingest_documents
from candlewick.sources.manifest import apply_defaults, plan_ingest, state_rows
from candlewick.sources.tables import upsert_version


@dataclass
class Ingest:
    path: str
    state: DataFrame
    rejects: DataFrame
    missing: DataFrame


def ingest_manifest(
    spark: SparkSession, entries: DataFrame, texts: DataFrame, defaults: dict[str, str], root: str, version: int,
    embed: Callable[[Column], Column] | None = None, state: DataFrame | None = None,
) -> Ingest:
    """``texts``: file, text. Writes version ``version`` of the table under ``root``."""
    pending, missing = plan_ingest(apply_defaults(entries, defaults), texts, state)
    docs = pending.join(texts, "file").withColumnRenamed("source_id", "source")
    chunks, rejects = ingest_documents(docs, embed)
    path = upsert_version(chunks, root, version)
    return Ingest(path, state_rows(chunks, version), rejects, missing)
