"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import replay_key


def stream_turns(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Conversations as they arrive in a folder of Parquet files."""
    schema = "conv_id bigint, turn bigint, role string, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_replay(items: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Append-only replay rows, each key once within the watermark."""
    return items.withColumn("replay_key", replay_key()).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["replay_key"])


def stream_activity(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """T5: counts and mean value by event type in tumbling or sliding windows; later rows are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """T5: sessions of each user, closed after ``gap`` without an event."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
