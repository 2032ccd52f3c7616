"""Structured Streaming over events and edges: an extension, as the reference data model has no streams.

Late-data rules are Spark's own: rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.merge import replace_outgoing


def read_events(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with ts as a timestamp that watermarks accept."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of tumbling (or sliding) windows; batch and stream give the same closed windows."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of runs of a user's events with gaps under `gap`."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_edges(path: str, spare: str):
    """A foreachBatch function that replaces the outgoing edges of each source in the batch.

    The table alternates between two folders, so that a batch that runs again reads what it read before: batch n writes to
    path when n is even, else to spare, from the other one.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        before, after = (spare, path) if epoch % 2 == 0 else (path, spare)
        spark = batch.sparkSession
        now = spark.read.schema(batch.schema).parquet(before)
        replace_outgoing(now, batch).write.mode("overwrite").parquet(after)

    return run
