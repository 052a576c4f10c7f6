"""Streaming counterparts: stage counters over an event stream, and arrival-order checks of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    """A folder of parquet files as a stream; ts without zone is taken as session time, as watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stage_counters(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, stage, n, total): tumbling counts and sums per stage; events later than `late` are dropped, state stays bounded.

    Works alike on a stream and on a table.
    """
    x = events.withWatermark("ts", late) if events.isStreaming else events
    g = x.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("stage"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "stage", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): sessions of each user."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    g = x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
