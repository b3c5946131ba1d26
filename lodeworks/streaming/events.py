"""Streaming extension: windowed counts with late data, and runs joined to releases as both arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they land in a folder (or a glob)."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per type and tumbling window; events later than ``late`` are left out once the window is closed."""
    g = events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    s = events.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def runs_before_release(runs: DataFrame, releases: DataFrame, hours: int = 6) -> DataFrame:
    """Stream-stream interval join: runs of a package within the hours before its release."""
    a = runs.withWatermark("at", "1 hour").select(F.col("user_id").alias("package"), F.col("event_id").alias("run_id"), F.col("at").alias("run_at"))
    b = releases.withWatermark("at", "1 hour").select(F.col("user_id").alias("released"), F.col("event_id").alias("release_id"), F.col("at").alias("release_at"))
    return a.join(b, F.expr(f"package = released AND run_at < release_at AND run_at >= release_at - INTERVAL {hours} HOURS")).select("package", "run_id", "release_id")


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs a stream over all that has landed and stops: into a memory table, or batch by batch into ``each``."""
    w = df.writeStream.outputMode(mode).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("memory").queryName(name)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return q
