"""Running counts over streams of sequence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base_counts(sites: DataFrame) -> DataFrame:
    """``taxon, state, n`` of a stream or table of ``taxon, site, state``; state grows with taxa and states only."""
    return sites.groupBy("taxon", "state").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, event_type, n, total`` per tumbling window of ``ts``; rows later than ``late`` are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
