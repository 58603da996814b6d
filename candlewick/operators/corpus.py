"""Documents to chunks: validation, word chunks, greedy splits, ids, metadata, figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from candlewick.functions.text import (
    chunk_id, context_prefix, figure_id, figure_text, prefixed, strip, words,
)
from candlewick.sources.bucketed import BucketedTable

# Metadata keys and allowed values.
METADATA_KEYS = ("title", "author", "asset_class", "topics", "evidence_level", "acquisition")
ASSET_CLASSES = ("fx", "equity", "futures", "general")
EVIDENCE_LEVELS = ("principle", "heuristic", "empirical")
ACQUISITIONS = ("owned", "purchase", "public_domain", "free_official")

# Chunking defaults.
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
MAX_CHUNK_CHARS = 1800


def word_chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunks of ``size`` words, the last one ending at the last word; blank text gives none."""
    step = max(1, size - overlap)
    none = F.array().cast("array<string>")

    def chunks(tokens: Column) -> Column:
        last = F.ceil(F.greatest(F.size(tokens) - size, F.lit(0)) / step).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda s: F.array_join(F.slice(tokens, s * step + 1, size), " "))
        return F.when(F.size(tokens) > 0, cut).otherwise(none)

    return F.coalesce(F.transform(F.array(words(text)), chunks)[0], none)


def _packed(chunk: Column, max_chars: int) -> Column:
    """Single-spaced text cut greedily at spaces into parts of at most ``max_chars``.

    The longest run that ends at a space is taken each time; a word longer than
    the limit is taken whole.
    """
    part = rf"(?s)(?: |\A)(.{{1,{max_chars}}}(?= |\z)|[^ ]+)"
    return F.when(F.length(chunk) <= max_chars, F.array(chunk)).otherwise(F.regexp_extract_all(chunk, F.lit(part), F.lit(1)))


def split_long(chunks: Column, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Re-split chunks over ``max_chars`` by greedy word packing."""
    spaced = lambda c: F.when(F.length(c) <= max_chars, c).otherwise(F.array_join(words(c), " "))
    return F.filter(F.flatten(F.transform(F.transform(chunks, spaced), lambda c: _packed(c, max_chars))), lambda p: p != "")


def text_pieces(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, max_chars: int = MAX_CHUNK_CHARS) -> Column:
    """Word chunks and their re-splits."""
    return F.flatten(F.transform(word_chunks(text, size, overlap), lambda c: _packed(c, max_chars)))


def normalize_metadata(docs: DataFrame) -> DataFrame:
    """Trimmed metadata columns, blanks as null; absent columns are added as null."""
    value = lambda k: F.nullif(strip(F.col(k).cast("string")), F.lit("")) if k in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({k: value(k) for k in METADATA_KEYS})


def metadata_problem() -> Column:
    """Why a document's metadata is invalid; null when it is fine. Expects normalized columns."""
    def outside(column: str, allowed: Sequence[str]) -> Column:
        bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
        return F.when(bad, F.concat(F.lit(f"Invalid {column}: "), F.col(column)))

    return F.coalesce(
        outside("asset_class", ASSET_CLASSES), outside("evidence_level", EVIDENCE_LEVELS), outside("acquisition", ACQUISITIONS)
    )


def unknown_keys(meta: Column) -> Column:
    """Reject reason for a metadata map with unknown keys; null when all are known."""
    extra = F.array_sort(F.array_except(F.map_keys(meta), F.array(*[F.lit(k) for k in METADATA_KEYS])))
    quoted = F.array_join(F.transform(extra, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    return F.when(F.size(extra) > 0, F.concat(F.lit("Unknown metadata keys: ["), quoted, F.lit("]")))


def validate_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with clean metadata, rejected documents with ``reason``)."""
    marked = normalize_metadata(docs).withColumn("reason", metadata_problem())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, max_chars: int = MAX_CHUNK_CHARS
) -> DataFrame:
    """Chunk rows of validated documents (source, text, metadata); row-local, no shuffle."""
    pieces = text_pieces(F.col("text"), size, overlap, max_chars)
    rows = docs.select("source", *METADATA_KEYS, F.posexplode(pieces).alias("chunk_index", "_chunk"))
    prefix = context_prefix(F.col("source"), F.col("author"), F.col("asset_class"), F.col("topics"))
    return rows.select(
        chunk_id(F.col("source"), F.col("chunk_index")).alias("id"),
        "source",
        F.lit("text").alias("chunk_type"),
        "chunk_index",
        *METADATA_KEYS,
        prefixed(F.col("_chunk"), prefix).alias("text"),
    )


def embed_texts(chunks: DataFrame, embed: Callable[[Column], Column], text: str = "text", vectors: BucketedTable | None = None) -> DataFrame:
    """Attach vectors from a caller-supplied column function, called once per distinct text; a null text has none.

    With ``vectors``, a table keyed by ``digest``, texts embedded in an earlier ingest are not
    embedded again: only buckets that can hold a wanted digest are read, and what is new is added as its next version.
    Rows then keep their ``digest``, by which readers of the table join without their texts.
    """
    named = chunks.withColumn("_digest", F.sha2(F.col(text), 256))
    # Texts travel to one row per digest; the digest alone joins them to their chunks.
    distinct = named.filter(F.col("_digest").isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.any_value(text).alias("_text"))
    if vectors is None:
        known = distinct.select("digest", embed(F.col("_text")).alias("embedding"))
    else:
        wanted = named.select(F.col("_digest").alias("digest")).filter("digest is not null").distinct()
        held = vectors.rows_for(wanted).select("digest") if vectors.version() else wanted.limit(0)
        fresh = distinct.join(held, "digest", "left_anti").select("digest", embed(F.col("_text")).alias("embedding"))
        vectors.upsert(fresh, vectors.version() + 1)
        known = vectors.rows_for(wanted).select("digest", "embedding")
    kept = [c for c in chunks.columns if c != "embedding" and (vectors is None or c != "digest")]
    joined = named.select(*kept, "_digest").join(known.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return joined.drop("_digest") if vectors is None else joined.select(*kept, "embedding", F.col("_digest").alias("digest"))


def ingest_documents(
    docs: DataFrame, embed: Callable[[Column], Column] | None = None, vectors: BucketedTable | None = None, **chunking
) -> tuple[DataFrame, DataFrame]:
    """(chunk rows ready to upsert, rejected documents)."""
    good, rejects = validate_documents(docs)
    chunks = chunk_documents(good, **chunking)
    return (chunks if embed is None else embed_texts(chunks, embed, vectors=vectors)), rejects


def ingest_figures(figures: DataFrame, captions: DataFrame, stored: DataFrame) -> DataFrame:
    """Figure rows not stored yet whose caption exists.

    ``figures``: source, page, figure_index, image_path, nearby, chunk_index and
    metadata; ``captions``: image_path, caption (null when captioning failed).
    """
    named = normalize_metadata(figures).withColumn("id", figure_id(F.col("source"), F.col("page"), F.col("figure_index")))
    fresh = named.join(stored.select("id"), "id", "left_anti").join(captions.filter(F.col("caption").isNotNull()), "image_path")
    prefix = context_prefix(F.col("source"), F.col("author"), F.col("asset_class"), F.col("topics"))
    return fresh.select(
        "id", "source", F.lit("figure").alias("chunk_type"), "chunk_index", "page", "figure_index", "image_path", *METADATA_KEYS,
        prefixed(figure_text(F.col("page"), F.col("caption"), F.col("nearby")), prefix).alias("text"),
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunk count and number of distinct sources."""
    per_source = chunks.groupBy("source").agg(F.count("*").alias("n"))
    return per_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.count("source").alias("source_count"))


def corpus_sources(chunks: DataFrame) -> DataFrame:
    """The distinct sources in order, with their chunk counts; a table, not one growing row."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks")).orderBy("source")


def source_chunk(chunks: DataFrame, source: str, index: int) -> DataFrame:
    """The chunk of one source and index; both filters reach the scan."""
    return chunks.filter((F.col("source") == source) & (F.col("chunk_index") == index))


def source_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Many lookups at once: chunks whose (source, chunk_index) is wanted."""
    return chunks.join(wanted.select("source", "chunk_index").distinct(), ["source", "chunk_index"], "left_semi")
