"""Incremental checks on a stream of events: an extension, as batch checks are all that a matrix needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows, mean and share above zero of each kind of event in a window, late rows being waited for."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("positive"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "positive")
