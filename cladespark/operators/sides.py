"""Sizes that are checked: of sides of joins before they are broadcast, and of what a task gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1 << 20


def counted(frame: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``frame``, marked for a broadcast if it has at most ``most`` narrow rows (no more are counted); else as it is, for a shuffle."""
    return F.broadcast(frame) if frame.select(F.lit(1)).limit(most + 1).count() <= most else frame


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """How many tasks to deal ``rows`` rows out to, so that each gets about ``most`` at any size of the table. Smaller tables still go to as many tasks as run at once."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, -(-16 * rows // most)))
