"""Progress events as a stream: the newest event of each run and phase, stale runs left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def progress_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """Events of a folder as files arrive; at most so many files a step bounds what is in flight."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def latest_by_phase(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest event of each run and phase in each hour; events later than the watermark are dropped, and their state with them."""
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    by_hour = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("user_id").alias("run"), F.col("event_type").alias("phase"))
    return by_hour.agg(newest.alias("e"), F.count("*").alias("n")).select("run", "phase", F.col("window.start").alias("hour"), "e.event_id", "e.value", "n")


def current_runs(events: DataFrame) -> DataFrame:
    """Batch form of stale-result suppression: of each user's events, those of the newest generation."""
    gen = F.expr("event_id div 1000")
    newest = events.groupBy("user_id").agg(F.max(gen).alias("newest"))
    return events.withColumn("generation", gen).join(newest, "user_id").where("generation = newest").drop("newest")
