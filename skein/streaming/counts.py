"""Counts of rows by columns that follow a stream: each micro-batch adds a table of its own counts, and a batch that runs again replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(rows: DataFrame, keys: list[str], folder: str, available_now: bool = True) -> StreamingQuery:
    """Starts counting a stream of rows by keys into a folder that all executors share."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def totals(spark: SparkSession, keys: list[str], folder: str) -> DataFrame:
    """The counts of all batches so far. A batch under way shows once its table stands."""
    rows = spark.read.parquet(f"{folder}/counts")
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))

