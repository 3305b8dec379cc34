"""Incremental loads: a file stream of changes, each batch merged by key into a versioned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest_changes(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Append each new file's rows to ``target`` with their batch number, once each; run again to take up new files.

    The batch number is part of the path, and a batch that is run again after
    a failure overwrites its own folder, so nothing is loaded twice.
    """

    def load(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        newest = batch.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
        newest.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("batch"))
    return spark.read.parquet(target).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "batch")


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window; as a stream, windows close once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
