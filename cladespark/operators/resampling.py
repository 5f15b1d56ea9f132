"""Resampling, windows and tests over sites. Random numbers are hashes of a counter, so any engine and partitioning repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .distances import paired_masks
from .sides import tasks_for

DRAWS = 1 << 18  #: draws that a task counts
BLOCK = 64  #: sites whose weights lie together as bits of longs


def hashed(key: Column, n: Column | int) -> Column:
    """A number from 0 to n - 1 out of the first eight hexadecimal digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def _draws(sites: DataFrame, reps: int, kind: str) -> tuple[DataFrame, int]:
    """``rep, pos, n`` for each draw, and n; ``sites``: ``pos`` from 0 to n - 1."""
    n = sites.count()
    drawn = sites.select("pos", F.lit(n).cast("long").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return drawn.withColumn("key", F.concat_ws(":", F.lit(kind), F.col("rep").cast("string"), F.col("pos").cast("string"))), n


def _times(drawn: DataFrame, draws: int) -> DataFrame:
    """``rep, pos, w``: most places are drawn once or twice, so draws are dealt out before they are counted, and a task counts a bounded number.

    Spark takes the result to be no larger than the table of sites, without the replicates: what joins it asks for a merge, or the driver would build a broadcast of all weights.
    """
    dealt = drawn.repartition(tasks_for(drawn.sparkSession, draws, DRAWS), "pos")
    return dealt.groupBy("rep", "pos").agg(F.count("*").alias("w"))


def bootstrap_weights(sites: DataFrame, reps: int) -> DataFrame:
    """``rep, pos, w``: how often each site is drawn with replacement; sites that aren't have no row."""
    drawn, n = _draws(sites, reps, "boot")
    return _times(drawn.select("rep", hashed(F.col("key"), F.col("n")).alias("pos")), n * reps)


def resampled_identity(sites: DataFrame, weights: DataFrame, n_states: int = 4) -> DataFrame:
    """``rep, i, j, same, total``: over the sites that taxa i < j both have, the weights of those where they agree, and of all. Pairs without a drawn site have no row.

    Pairs are made once for 64 sites, as masks. Weights meet them as masks too, one for each binary digit of a block's weights, so no row of a pair and a site is made.
    """
    every = weights.withColumn("digit", F.explode(F.sequence(F.lit(0), F.floor(F.log2("w") + 1e-9).cast("int")))).where("getbit(w, digit) = 1")
    digits = every.groupBy("rep", F.floor(F.col("pos") / BLOCK).alias("block"), "digit")
    digits = digits.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pos, {BLOCK}) AS int))")).alias("drawn"))
    met = paired_masks(sites, n_states).join(digits.hint("merge"), "block")
    times = lambda mask: F.sum(F.expr(f"shiftleft(cast(bit_count({mask} & drawn) AS long), digit)"))
    return met.groupBy("rep", "i", "j").agg(times("same").alias("same"), times("total").alias("total")).where("total > 0")


def block_weights(sites: DataFrame, reps: int, size: int) -> DataFrame:
    """Blocks of ``size`` sites from random starts, around the end; as many whole blocks as fit into the number of sites."""
    drawn, n = _draws(sites, reps, "block")
    drawn = drawn.where(F.col("pos") < F.floor(F.col("n") / size))
    start = hashed(F.col("key"), F.col("n"))
    spread = drawn.select("rep", "n", F.explode(F.sequence(start, start + (size - 1))).alias("at"))
    return _times(spread.select("rep", (F.col("at") % F.col("n")).alias("pos")), n * reps)


def jackknife_weights(sites: DataFrame, reps: int, fraction: float = 0.5) -> DataFrame:
    """The sites kept when ``fraction`` of them stays, drawn without replacement: those with the least hashes.

    Hashes are counted by their first digits, so only the sites in the one bucket of a replicate that is cut are ranked.
    """
    keyed = _draws(sites, reps, "jack")[0].withColumn("h", F.md5("key")).withColumn("bucket", F.substring("h", 1, 3))
    counts = keyed.groupBy("rep", "bucket").agg(F.count("*").alias("here"), F.first("n").alias("n"))
    upto = F.sum("here").over(Window.partitionBy("rep").orderBy("bucket"))  # at most 4096 rows a replicate
    bounds = counts.select("rep", "bucket", (F.floor(F.col("n") * fraction + 0.5) - upto + F.col("here")).alias("left"), "here").where("left > 0")
    met = keyed.select("rep", "pos", "h", "bucket").join(F.broadcast(bounds), ["rep", "bucket"])
    rank = F.row_number().over(Window.partitionBy("rep", "bucket").orderBy("h", "pos"))
    cut = met.where("left < here").withColumn("rank", rank).where("rank <= left")
    return met.where("left >= here").select("rep", "pos").unionByName(cut.select("rep", "pos")).select("rep", "pos", F.lit(1).cast("long").alias("w"))


def sliding_windows(lnl: DataFrame, size: int, step: int, threshold: float) -> DataFrame:
    """Anomalous windows of sites ``pos, lnl``: ``start, n, total, delta, z, anomaly``.

    A site goes to each of its windows, which are then groups: no task sees all sites. ``delta`` is the window's sum less its
    share of the alignment's, ``z`` standardises it over all windows.
    """
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    whole = lnl.agg(F.sum("lnl").alias("all"), F.count("*").alias("n_all"), F.max("pos").alias("end"))
    spread = lnl.where(last >= first).withColumn("k", F.explode(F.sequence(first, last))).join(F.broadcast(whole)).where(F.col("k") * step + size <= F.col("end") + 1)
    windows = spread.groupBy((F.col("k") * step).alias("start")).agg(F.count("*").alias("n"), F.sum("lnl").alias("total"), F.first("all").alias("all"), F.first("n_all").alias("n_all"))
    windows = windows.withColumn("delta", F.col("total") - F.col("n") / F.col("n_all") * F.col("all"))
    spread = windows.agg(F.avg("delta").alias("m"), F.stddev_samp("delta").alias("s"))
    z = F.try_divide(F.col("delta") - F.col("m"), F.col("s"))
    rounded = [F.round(c, 4).alias(n) for c, n in ((F.col("total"), "total"), (F.col("delta"), "delta"), (z, "z"))]
    return windows.join(F.broadcast(spread)).select("start", "n", *rounded, (F.abs(F.round(z, 4)) > threshold).alias("anomaly"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by the polynomial 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * z)
    # The polynomial's coefficients.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def paired_test(lnl: DataFrame) -> DataFrame:
    """Two-sided test that two trees have equal likelihood: ``t1, t2, diff, z, p`` of site likelihoods ``tree, pos, lnl``."""
    x, y = lnl.select(F.col("tree").alias("t1"), "pos", F.col("lnl").alias("a")), lnl.select(F.col("tree").alias("t2"), "pos", F.col("lnl").alias("b"))
    d = F.col("a") - F.col("b")
    sums = x.join(y, "pos").where("t1 < t2").groupBy("t1", "t2").agg(F.sum(d).alias("diff"), F.avg(d).alias("m"), F.var_samp(d).alias("v"), F.count("*").alias("n"))
    z = F.when(F.col("v") > 0, F.col("m") / F.sqrt(F.col("v") / F.col("n")))
    return sums.select("t1", "t2", F.round("diff", 4).alias("diff"), F.round(z, 4).alias("z"), F.round(2 * normal_tail(F.abs(z)), 4).alias("p"))


def resampled_support(lnl: DataFrame, weights: DataFrame) -> DataFrame:
    """``tree, wins, share``: in how many replicates each tree has the greatest weighted likelihood (ties: the first tree)."""
    lnl = cut(lnl)
    # A row for each replicate and tree; of a replicate without sites of any tree one without a tree.
    sums = cut(weights.join(lnl.hint("merge"), "pos", "left").groupBy("rep", "tree").agg(F.sum(F.col("lnl") * F.col("w")).alias("l")))
    best = sums.where("tree is not null").groupBy("rep").agg(F.min(F.struct((-F.round("l", 6)).alias("l"), "tree")).alias("b")).groupBy(F.col("b.tree").alias("tree")).agg(F.count("*").alias("wins"))
    reps = sums.agg(F.countDistinct("rep").alias("reps"))
    every = lnl.select("tree").distinct()
    wins = F.coalesce("wins", F.lit(0))
    return every.join(best, "tree", "left").join(F.broadcast(reps)).select("tree", wins.alias("wins"), F.round(wins / F.col("reps"), 6).alias("share"))


def information_criteria(models: DataFrame) -> DataFrame:
    """``model, lnl, k, aic, aicc, bic, weight`` of ``model, lnl, k, n``; weights are Akaike's."""
    aic = 2 * F.col("k") - 2 * F.col("lnl")
    aicc = aic + 2 * F.col("k") * (F.col("k") + 1) / (F.col("n") - F.col("k") - 1)
    scored = models.select("model", "lnl", "k", aic.alias("aic"), aicc.alias("aicc"), (F.col("k") * F.log("n") - 2 * F.col("lnl")).alias("bic"))
    least = scored.agg(F.min("aic").alias("low"))
    scored = scored.join(F.broadcast(least)).withColumn("e", F.exp(-(F.col("aic") - F.col("low")) / 2))
    total = scored.agg(F.sum("e").alias("t"))
    lnl, *rounded = (F.round(c, 4).alias(c) for c in ("lnl", "aic", "aicc", "bic"))
    return scored.join(F.broadcast(total)).select("model", lnl, "k", *rounded, F.round(F.col("e") / F.col("t"), 6).alias("weight"))
