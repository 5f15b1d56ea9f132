"""Sets of areas as bit masks, their lattice as tables, and least-cost area histories by min-plus products over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .folds import Shape, keys
from .sides import counted

MOST_AREAS = 20


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def intersection(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def difference(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def subset(a: Column, b: Column) -> Column:
    return difference(a, b) == 0


def disjoint(a: Column, b: Column) -> Column:
    return intersection(a, b) == 0


def size(a: Column) -> Column:
    return F.bit_count(a)


def members(a: Column, n_areas: int) -> Column:
    """The areas of a set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_areas - 1)), lambda k: F.getbit(a, k) == 1)


def of_members(areas: Column) -> Column:
    """The set of an array of areas."""
    return F.aggregate(areas, F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(F.pow(F.lit(2.0), k).cast("long")))


def subsets(spark: SparkSession, n_areas: int, most: int | None = None) -> DataFrame:
    """``mask``: every non-empty set of areas, of at most ``most`` areas."""
    if not 0 < n_areas <= MOST_AREAS:
        raise ValueError(f"1 to {MOST_AREAS} areas, not {n_areas}: the lattice has a row for each set")
    found = spark.range(1, 1 << n_areas).select(F.col("id").alias("mask"))
    return found if most is None else found.where(size(F.col("mask")) <= most)


def bipartitions(spark: SparkSession, n_areas: int, most: int | None = None) -> DataFrame:
    """``mask, a, b``: each unordered division of a set into two disjoint non-empty ones once, ``a < b``.

    A set's parts are explored area by area (each goes to one side), so the rows made are those of the result and their mirror images.
    """
    current = subsets(spark, n_areas, most).select("mask", F.lit(0).cast("long").alias("a"))
    for k in range(n_areas):
        bit = F.lit(1 << k).cast("long")
        sides = F.when(F.getbit("mask", F.lit(k)) == 1, F.array(F.col("a"), F.col("a").bitwiseOR(bit))).otherwise(F.array(F.col("a")))
        current = current.select("mask", F.explode(sides).alias("a"))
    return current.select("mask", "a", difference(F.col("mask"), F.col("a")).alias("b")).where("a > 0 and a < b")


def changes(spark: SparkSession, n_areas: int, dispersal: float = 1.0, extinction: float = 1.0) -> DataFrame:
    """``above, below, step``: the cost along a branch of each area gained and each lost, for all pairs of sets (as the lattice squared, it is small or shuffled)."""
    every = subsets(spark, n_areas)
    pairs = every.select(F.col("mask").alias("above"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << n_areas) - 1).cast("long"))).alias("below"))
    gained, lost = size(difference(F.col("below"), F.col("above"))), size(difference(F.col("above"), F.col("below")))
    return pairs.withColumn("step", gained * F.lit(float(dispersal)) + lost * F.lit(float(extinction)))


def area_histories(tree: DataFrame, tips: DataFrame, n_areas: int, dispersal: float = 1.0, extinction: float = 1.0, most: int | None = None) -> DataFrame:
    """``[tree,] node, mask, cost`` of every inner node and set of areas: the least cost of the clade below if the node has that set.

    A set passes to two children either divided into two disjoint sets or whole to both; to a single child, whole. ``tree``: a tree or forest of
    at most two children a node; ``tips``: ``node, mask`` observed. ``most``: the largest set of an inner node. Level by level, each branch is a min-plus product with
    ``changes`` and each node one with ``bipartitions``.
    """
    key, shape, spark = keys(tree), Shape(tree), tree.sparkSession
    if not tree.where("parent is not null").groupBy(*key, "parent").count().where("count > 2").isEmpty():
        raise ValueError("area histories need a binary tree")
    steps, parts = counted(changes(spark, n_areas, dispersal, extinction)), counted(bipartitions(spark, n_areas, most))
    edges = shape.side(tree.select(*key, "node", "parent", "ord", "level"))
    leaves = tips.select("node", F.col("mask").cast("long").alias("mask"), F.lit(0.0).alias("cost")).join(shape.side(tree.select(*key, "node", "level")), "node")
    done = current = None
    for level in range(shape.height, 0, -1):
        own = leaves.where(F.col("level") == level).drop("level")
        current = own if current is None else own.unionByName(current)
        current = cut(current)
        across = current.join(steps, F.col("mask") == F.col("below")).groupBy(*key, "node", F.col("above").alias("mask")).agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
        arrived = cut(across).join(edges.where(F.col("level") == level), [*key, "node"]).select(*key, F.col("parent").alias("node"), "ord", "mask", "cost")
        whole = arrived.groupBy(*key, "node", "mask").agg(F.sum("cost").alias("cost"))
        if most is not None:
            whole = whole.where(size(F.col("mask")) <= most)
        first = arrived.select(*key, "node", F.col("ord").alias("o"), F.col("mask").alias("a"), F.col("cost").alias("x"))
        second = arrived.select(*key, "node", F.col("ord").alias("p"), F.col("mask").alias("b"), F.col("cost").alias("y"))
        divided = first.join(parts, "a").join(second, [*key, "node", "b"]).where("o <> p")
        divided = divided.select(*key, "node", "mask", (F.col("x") + F.col("y")).alias("cost"))
        current = whole.unionByName(divided).groupBy(*key, "node", "mask").agg(F.min("cost").alias("cost"))
        done = current if done is None else done.unionByName(current)
    return done


def best_sets(histories: DataFrame) -> DataFrame:
    """``[tree,] node, cost, best``: each node's least cost and the sets, ascending, that have it."""
    key = keys(histories)
    low = histories.groupBy(*key, "node").agg(F.min("cost").alias("least"))
    met = histories.join(low, [*key, "node"]).where("cost = least")
    return met.groupBy(*key, "node").agg(F.min("cost").alias("cost"), F.array_sort(F.collect_list("mask")).alias("best"))
