"""The campaign's append-only event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.campaign import EVENT_SCHEMA, typed_events


def stream_events(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """New files of event lines below a folder, typed."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_a_trigger).csv(folder)
    return typed_events(raw)


def status_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window, topology and status; state is bounded by the watermark."""
    counted = events.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), "topology", "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "topology", "status", "n")
