"""A training corpus from raw documents: five stages, each reading what the one before kept.

Every stage takes (spark, docs, sf_dir) and all columns of ``docs`` ride along in one
struct, so their names clash with nothing. All stages but the last return the columns
they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewick.llm import decontaminate, lsh_forest, slack_packing, suffix_dedup, toxicity
from candlewick.llm.common import documents, small_batches, stored
from candlewick.llm.positions import numbered

#: Words of a shingle and least likeness in percent of near copies.
SHINGLE_WORDS, LIKENESS = 5, 80


def _carried(docs: DataFrame) -> DataFrame:
    """(key, text, __row): what a stage works on, and the row it came from."""
    return docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.struct(*docs.columns).alias("__row"))


def _rows(carried: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The rows that stayed, with the columns of ``docs``; a changed text changes its n_chars."""
    if text is None:
        return carried.select("__row.*")
    changed = ~F.col(text).eqNullSafe(F.col("__row.text"))
    columns = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return carried.select(*[columns.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of two thirds of them."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    scored = toxicity.score(spark, _carried(docs), model, text="__text", column="__score")
    return _rows(scored.filter(F.col("__score") < toxicity.CUT), docs)


def _row_keys(docs: DataFrame) -> DataFrame:
    """Carried rows with ``__key``: the number, where every row has one of its own.

    Otherwise rows are numbered in its order (rows without one last, then by text and by all
    columns), so that two texts under one number are two documents; rows that are equal in all columns are one.
    """
    carried = _carried(docs)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return carried.withColumn("__key", F.col("__id"))
    told = {"__text_hash": F.sha2(F.coalesce("__text", F.lit("")), 256), "__row_hash": F.sha2(F.to_json("__row"), 256)}
    carried = stored(carried.withColumns(told), "carried")
    names = ["__id", *told]
    order = [F.col("__id").asc_nulls_last(), *told]
    places = numbered(carried.select(*names).distinct(), [F.col(c) if isinstance(c, str) else c for c in order], name="__key").drop("__key_total")
    places = places.select(*[F.col(c).alias(f"_{c}") for c in names], "__key")
    same = F.col("__id").eqNullSafe(F.col("___id"))
    for c in told:
        same &= F.col(c) == F.col(f"_{c}")
    return carried.join(places, same).select("__id", "__text", "__row", "__key")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest number (rows without one after all others)."""
    small_batches(spark)
    carried = _row_keys(docs)
    found = lsh_forest.near_copies(carried.select("__key", "__text"), SHINGLE_WORDS, LIKENESS, text="__text", key="__key")
    kept = found.filter("kept").select("__key").distinct()
    # Rows that still share a key are equal in all columns.
    return _rows(carried.join(kept, "__key").dropDuplicates(["__key"]).select("__row"), docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too; a text of which nothing is left goes."""
    small_batches(spark)
    found = suffix_dedup.repeated_passages(_carried(docs), text="__text", key="__id")
    emptied = (F.size("runs") > 0) & (F.coalesce(F.length("kept_text"), F.lit(0)) == 0)
    return _rows(found.filter(~emptied), docs, "kept_text")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's windows; a text of which no word is left goes."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_carried(docs), benchmark, text="__text")
    return _rows(decontaminate.without_spans(found, text="__text"), docs, "__text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 2048 tokens."""
    small_batches(spark)
    return slack_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: A trained classifier decides the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
