"""Structured Streaming over event tables (an extension: the batch operators' streaming form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(df: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by window and type; rows later than ``late`` are left out in a stream.
    NULL times belong to no window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = df.where("ts is not null").withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user, ended by a gap."""
    g = df.where("ts is not null").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", F.round("total", 4).alias("total"))


def distinct_events(df: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once; state older than ``late`` is dropped."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available now, to Parquet, exactly once across restarts by the checkpoint."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
