"""Run a stream over what has arrived and hand back its stored output."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from candlewick.session import fresh_path


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode into a parquet sink and read that."""
    root = fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def arrivals(spark: SparkSession, slices: Iterable[DataFrame], name: str) -> Iterator[DataFrame]:
    """The same file stream after each slice has arrived; a query that keeps its checkpoint sees one slice a run.

    A slice is written by all its tasks, as a source would deliver it.
    """
    path = fresh_path(spark, name)
    for arrived in slices:
        arrived.write.mode("append").parquet(path)
        yield spark.readStream.schema(arrived.schema).parquet(path)


def drain_arrivals(spark: SparkSession, slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Stored output of ``build`` over slices that arrive one after the other, each in a run of the query that goes on from the last."""
    root, schema = fresh_path(spark, name), None
    for arrived in arrivals(spark, slices, f"{name}-in"):
        result = build(arrived)
        schema = result.schema
        query = (
            result.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/rows")
