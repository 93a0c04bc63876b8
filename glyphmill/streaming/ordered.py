"""Ordered finalisation of blocks as they arrive, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def finalize_in_order(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], files_at_once: int = 1) -> StreamingQuery:
    """Files of `source` are prepared as they come, `files_at_once` in flight, and written in the order of their batches.

    A batch is written to a folder of its own number, so one that is run again after a failure
    replaces itself. The query ends when nothing is left.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def finalize(batch: DataFrame, number: int) -> None:
        prepare(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    return stream.writeStream.foreachBatch(finalize).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    """Counts by key and event-time window; rows later than `late` are past their window's end."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
