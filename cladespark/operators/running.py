"""Running sums over any number of rows: sums of ranges, running sums of those, and running sums inside each range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sides import MOST_ROWS, counted

RANGE = 4096  #: positions of a range, which one task sorts


def running_sum(rows: DataFrame, value: str, order: str = "pos", keys: tuple[str, ...] = (), width: int = RANGE, at_once: int = MOST_ROWS) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` up to and with each row, in the order of the whole numbers in ``order``, for each of ``keys``.

    Rows of one position come in any order, each with a total of its own. Sums of ranges are themselves summed up in the same way while they are
    more than ``at_once``; only then one task (for each key) sorts them. Null values count as 0; the sum of no rows is none.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width).cast("long"))
    sums = cut(ranged.groupBy(*keys, "_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum")))
    if sums.count() > at_once and width > 1:
        renamed = sums.withColumnsRenamed({"_range": "_place", "_sum": "_part"})
        summed = running_sum(renamed, "_part", "_place", keys, width, at_once).withColumnsRenamed({"_place": "_range", "_part": "_sum", "total": "_upto"})
    else:
        summed = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range")))
    before = counted(summed.select(*keys, "_range", (F.col("_upto") - F.col("_sum")).alias("_before")))
    inside = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(before, [*keys, "_range"]).withColumn("total", F.col("_before") + inside).drop("_range", "_before")


def draw_positions(weights: DataFrame, draws: DataFrame, value: str = "w", order: str = "pos", width: int = RANGE) -> DataFrame:
    """``draws`` (with ``u`` in [0, 1)) and ``pos``: the first position whose share of the running sum of weights exceeds ``u``.

    A draw finds its range among the ranges' sums first, and its place in that range by an equi-join on it.
    """
    summed = running_sum(weights.where(F.col(value) > 0), value, order, width=width).select(F.col(order).alias("pos"), F.col("total").alias("hi"), (F.col("total") - F.col(value)).alias("lo"))
    whole = summed.agg(F.max("hi").alias("whole"))
    slot = lambda c: F.floor(c * 1024).cast("long")
    shares = summed.join(F.broadcast(whole)).select("pos", (F.col("lo") / F.col("whole")).alias("lo"), (F.col("hi") / F.col("whole")).alias("hi"))
    spread = shares.withColumn("_slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    return draws.withColumn("_slot", slot(F.col("u"))).join(spread, "_slot").where("u >= lo and u < hi").drop("_slot", "lo", "hi")
