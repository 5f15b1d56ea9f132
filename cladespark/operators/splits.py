"""Splits of trees as bit masks, and what is computed from sets of them. A mask holds up to 63 taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK_TREES = 512  #: trees on either side of a block of pairs, about
SPLITS_AT_ONCE = 4096  #: of the most frequent splits that may still fit, for each round of the extended consensus


def clade_masks(nodes: DataFrame) -> DataFrame:
    """``tree, mask, bl`` of clades out of rows ``tree, node, bit, bl``, one for each tip under a node."""
    return nodes.groupBy("tree", "node").agg(F.bit_or("bit").alias("mask"), F.max("bl").alias("bl")).select("tree", "mask", "bl")


def canonical(masks: DataFrame, n_taxa: int) -> DataFrame:
    """Distinct non-trivial splits ``tree, split, bl``: the side without taxon 0. Of repeated splits the lengths add up."""
    full = (1 << n_taxa) - 1
    side = F.when(F.col("mask").bitwiseAND(F.lit(1)) == 1, F.lit(full) - F.col("mask")).otherwise(F.col("mask"))
    size = F.bit_count(F.col("split"))
    found = masks.select("tree", side.cast("long").alias("split"), "bl").where((size > 1) & (size < n_taxa - 1))
    return found.groupBy("tree", "split").agg(F.sum("bl").alias("bl"))


def compatible(x, y, full: int):
    """Two splits fit one tree if one of the four intersections of their sides is empty."""
    other = lambda c: F.lit(full) - c
    sides = ((x, y), (x, other(y)), (other(x), y), (other(x), other(y)))
    out = F.lit(False)
    for a, b in sides:
        out = out | (a.bitwiseAND(b) == 0)
    return out


def tree_distances(splits: DataFrame, n_taxa: int) -> DataFrame:
    """``t1 < t2, rf, nrf, bsd``: symmetric difference of split sets, the same over its maximum, and the branch-score distance."""
    sizes = splits.groupBy("tree").agg(F.count("*").alias("n"), F.sum(F.col("bl") * F.col("bl")).alias("sq"))
    x, y = splits.select(F.col("tree").alias("t1"), "split", F.col("bl").alias("b1")), splits.select(F.col("tree").alias("t2"), "split", F.col("bl").alias("b2"))
    shared = x.join(y, "split").where("t1 < t2").groupBy("t1", "t2").agg(F.count("*").alias("k"), F.sum(F.col("b1") * F.col("b2")).alias("dot"))
    # Every pair is wanted, so they are dealt out in blocks: a tree goes once to each pair of its block with another block.
    blocks = sizes.agg(F.ceil(F.count("*") / BLOCK_TREES).alias("blocks"))  # one row
    block, other = F.pmod(F.xxhash64("tree"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = lambda own, far: sizes.join(F.broadcast(blocks)).withColumn(own, block).withColumn(far, other).drop("blocks")
    a = dealt("x", "y").withColumnsRenamed({"tree": "t1", "n": "n1", "sq": "s1"})
    b = dealt("y", "x").withColumnsRenamed({"tree": "t2", "n": "n2", "sq": "s2"})
    pairs = a.join(b, ["x", "y"]).where("t1 < t2").join(shared, ["t1", "t2"], "left")
    rf = F.col("n1") + F.col("n2") - 2 * F.coalesce("k", F.lit(0))
    square = F.col("s1") + F.col("s2") - 2 * F.coalesce("dot", F.lit(0.0))
    most = 2 * (n_taxa - 3)
    return pairs.select("t1", "t2", rf.alias("rf"), F.round(rf / most if n_taxa > 3 else F.lit(0.0), 6).alias("nrf"), F.round(F.sqrt(F.greatest(square, F.lit(0.0))), 6).alias("bsd"))


def split_support(splits: DataFrame) -> DataFrame:
    """``split, n, support, bl``: in how many trees a split is, the share of them, and its mean length."""
    trees = splits.agg(F.countDistinct("tree").alias("trees"))
    counts = splits.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("bl"), 6).alias("bl"))
    return counts.join(F.broadcast(trees)).select("split", "n", F.round(F.col("n") / F.col("trees"), 6).alias("support"), "bl")


def consensus(splits: DataFrame, method: str = "majority", threshold: float = 0.5, n_taxa: int | None = None) -> DataFrame:
    """Splits of the strict, the majority, a threshold, or the extended majority consensus, which needs ``n_taxa``."""
    support = split_support(splits)
    if method == "extended":
        return extended_majority(support, n_taxa)
    rule = {"strict": F.col("support") >= 1, "majority": F.col("support") > 0.5, "threshold": F.col("support") >= threshold}[method]
    return support.where(rule)


def fit(a: int, b: int, full: int) -> bool:
    return not a & b or not a & ~b or not b & ~a or not full & ~(a | b)


def extended_majority(support: DataFrame, n_taxa: int) -> DataFrame:
    """The majority splits, then others by falling support (ties: fewer taxa, then the smaller mask) as long as each fits all taken before.

    A tree has at most ``n_taxa - 3`` splits. Executors leave out what doesn't fit the ones taken so far; the driver sees the
    ``SPLITS_AT_ONCE`` first of the rest, until there is none.
    """
    full = (1 << n_taxa) - 1
    support = cut(support)
    taken: list[int] = []
    size = F.bit_count("split")
    while len(taken) < max(0, n_taxa - 3):
        rest = support.where(~F.col("split").isin(taken)) if taken else support
        for mask in taken:
            rest = rest.where(compatible(F.col("split"), F.lit(mask), full))
        found = [r.split for r in rest.orderBy(F.desc("n"), size, "split").select("split").limit(SPLITS_AT_ONCE).collect()]
        before = len(taken)
        for split in found:
            if len(taken) < n_taxa - 3 and all(fit(split, t, full) for t in taken):
                taken.append(split)
        if len(taken) == before:
            break
    return support.where(F.col("split").isin(taken)) if taken else support.limit(0)


def consensus_tree(accepted: DataFrame, n_taxa: int) -> DataFrame:
    """``node, parent, taxa, support, bl`` of the tree of compatible splits: nodes are masks of the taxa below; the root, all taxa, has no parent.

    A node's parent is the smallest split that holds it. ``accepted`` has at most ``n_taxa - 3`` rows, so it is broadcast.
    """
    spark = accepted.sparkSession
    full = (1 << n_taxa) - 1
    leaves = spark.range(n_taxa).select(F.expr("shiftleft(1L, cast(id AS int))").alias("node"), F.lit(None).cast("double").alias("support"), F.lit(None).cast("double").alias("bl"))
    inner = accepted.select(F.col("split").alias("node"), F.col("support").cast("double").alias("support"), "bl")
    up = inner.select(F.col("node").alias("above")).unionByName(spark.range(1).select(F.lit(full).cast("long").alias("above")))
    found = leaves.unionByName(inner).join(F.broadcast(up), (F.col("above") != F.col("node")) & (F.col("above").bitwiseAND(F.col("node")) == F.col("node")))
    parents = found.groupBy("node").agg(F.min_by("above", F.struct(F.bit_count("above"), "above")).alias("parent"), F.first("support").alias("support"), F.first("bl").alias("bl"))
    root = spark.range(1).select(F.lit(full).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("support"), F.lit(None).cast("double").alias("bl"))
    return parents.unionByName(root).select("node", "parent", F.bit_count("node").alias("taxa"), "support", "bl")


def check_taxa(clades: DataFrame) -> None:
    """Raise ``ValueError`` where the trees don't all have the same taxa. ``clades``: ``tree, mask`` with each tree's root among its clades."""
    found = clades.groupBy("tree").agg(F.bit_or("mask").alias("taxa")).select("taxa").distinct().limit(2).count()
    if found > 1:
        raise ValueError("the trees have different taxa")


def reference_support(reference: DataFrame, replicates: DataFrame) -> DataFrame:
    """``split, support`` in percent of the replicates that have each split of the reference tree."""
    trees = replicates.agg(F.countDistinct("tree").alias("trees"))
    counts = replicates.groupBy("split").agg(F.countDistinct("tree").alias("n"))
    found = reference.select("split").distinct().join(counts, "split", "left").join(F.broadcast(trees))
    return found.select("split", F.round(100 * F.coalesce("n", F.lit(0)) / F.col("trees"), 6).alias("support"))
