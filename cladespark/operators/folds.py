"""Folds over trees, site by site. A tree is a relation ``node, parent, ord, bl, level`` with levels counted from the root.

A fold goes up level by level: states of a level's nodes join their parents and are combined there by an aggregation, so the
number of joins is the tree's height and all sites and nodes of a level go at once. With a column ``tree`` the relation is a forest, whose trees may
differ in shape and height and share the nodes of their tips: every fold then goes over all trees in one job and its results carry ``tree``.

A fold whose leaves are dealt out by site needs no other shuffle. Where columns repeat, :func:`over_patterns` folds one of each kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sides import MOST_ROWS, counted

State = dict[str, Column]
BLOCK = 64  #: sites whose sets go up together as bits of longs


def keys(tree: DataFrame) -> list[str]:
    """The columns that tell trees apart."""
    return ["tree"] if "tree" in tree.columns else []


class Shape:
    """The height of a tree or forest, and whether its parts are small enough for a broadcast: one pass over its nodes tells both."""

    def __init__(self, tree: DataFrame):
        height, nodes = tree.agg(F.max("level"), F.count("*")).first()
        self.height, self.small = height or 0, nodes <= MOST_ROWS

    def side(self, part: DataFrame) -> DataFrame:
        return F.broadcast(part) if self.small else part


def height_of(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0] or 0


def with_levels(edges: DataFrame) -> DataFrame:
    """``edges`` (``[tree,] node, parent, ...``) with the ``level`` of each node, a join for each level. Nodes that no root reaches are an error.

    Edges and result are written to the checkpoint folder, as every fold reads them level by level.
    """
    key = keys(edges)
    edges = cut(edges)
    links = counted(edges.select(*key, "node", "parent"))
    current = cut(edges.where("parent is null").select(*key, "node"))
    found, level, reached = current.withColumn("level", F.lit(0)), 0, current.count()
    while True:
        current = cut(links.join(current.select(*key, F.col("node").alias("parent")), [*key, "parent"]).select(*key, "node"))
        level += 1
        if not (more := current.count()):
            break
        reached += more
        found = found.unionByName(current.withColumn("level", F.lit(level)))
    if reached != edges.count():
        raise ValueError("some nodes hang from no root")
    return cut(edges.join(counted(found), [*key, "node"]))


def fold_up(
    tree: DataFrame, leaves: DataFrame, combine: Callable[[], State], carry: tuple[str, ...] = (), after: Callable[[DataFrame], DataFrame] = lambda x: x, root_only: bool = False
) -> DataFrame:
    """States of all nodes, or of the roots alone, for which each level is computed once. ``leaves``: ``node, site`` and state columns; ``combine`` gives
    the aggregates, by state column, over the children of a node, which have ``ord`` and ``bl`` beside their states; ``after`` changes the states of a level.
    In a forest ``leaves`` may have ``tree`` as well, where tips aren't shared. Only tips have states of their own."""
    key, shape = keys(tree), Shape(tree)
    edges = shape.side(tree.select(*key, "node", "parent", "ord", "bl", "level"))
    tips = leaves.join(shape.side(tree.select(*key, "node", "level")), [*(k for k in key if k in leaves.columns), "node"])
    done, current = tips.drop("level"), None
    for level in range(shape.height, 0, -1):
        own = tips.where(F.col("level") == level).drop("level")
        current = own if current is None else own.unionByName(current)
        joined = current.join(edges.where(F.col("level") == level), [*key, "node"])
        current = after(joined.groupBy(*key, F.col("parent").alias("node"), "site", *carry).agg(*(c.alias(k) for k, c in combine().items())))
        done = done.unionByName(current)
    return current if root_only and current is not None else done


def patterns(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dictionary of columns: ``site, pattern`` of each site, ``pattern`` being the least site with the same states at the same tips; and ``pattern, weight``.

    ``leaves``: ``node, site, state`` (or ``mask``). A column is told by two hashes that are summed up before the shuffle, so no task holds a column's taxa together.
    """
    state = "mask" if "mask" in leaves.columns else "state"
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), "node", state)).alias(f"h{k}") for k in (0, 1)]
    columns = leaves.groupBy("site").agg(*hashes, F.count("*").alias("tips"))
    known = columns.groupBy("h0", "h1", "tips").agg(F.min("site").alias("pattern"), F.count("*").alias("weight"))
    return columns.join(known, ["h0", "h1", "tips"]).select("site", "pattern"), known.select("pattern", "weight")


def over_patterns(leaves: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``fold`` gives for every site of ``leaves``, from one site of each pattern and a join back. It pays where columns repeat."""
    leaves = cut(leaves)  # read for the dictionary and for the fold
    sites, known = patterns(leaves)
    sites = cut(sites)
    chosen = leaves.join(known.select(F.col("pattern").alias("site")), "site", "left_semi")
    return sites.join(fold(chosen).withColumnRenamed("site", "pattern"), "pattern").drop("pattern")


def tips_of(tree: DataFrame) -> DataFrame:
    """``[tree,] node`` of the nodes without children."""
    on = [*keys(tree), "node"]
    return tree.select(*on).join(tree.select(*keys(tree), F.col("parent").alias("node")), on, "left_anti")


def check_tips(tree: DataFrame, rows: DataFrame) -> None:
    """Raise ``ValueError`` where the tips of a tree, or of any tree of a forest, and the nodes of ``rows`` (``node``) aren't the same."""
    key = keys(tree)
    tips, known = tips_of(tree), rows.select("node").distinct()
    said = lambda r: " of ".join(str(r[k]) for k in ("node", *key))
    if missing := [said(r) for r in tips.join(known, "node", "left_anti").orderBy(*key, "node").limit(5).collect()]:
        raise ValueError(f"tips without data: {', '.join(missing)}")
    if missing := [str(r.node) for r in known.join(tips.select("node").distinct(), "node", "left_anti").orderBy("node").limit(5).collect()]:
        raise ValueError(f"data without a tip: {', '.join(missing)}")
    if key:
        short = tips.groupBy(*key).agg(F.countDistinct("node").alias("n")).where(F.col("n") < known.count())
        if trees := [str(r.tree) for r in short.orderBy("tree").limit(5).collect()]:
            raise ValueError(f"trees without a tip for all data: {', '.join(trees)}")


def site_sets(leaves: DataFrame, n_states: int = 4) -> DataFrame:
    """``node, block, m0 .., seen``: of each block of sites which ones may have each state, and which are known, as bits; an unknown site may have any."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(site, {BLOCK}) AS int))")
    bits = lambda kept: F.bit_or(F.when(kept, bit).otherwise(F.lit(0).cast("long")))
    sets = (bits(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0).alias(f"m{k}") for k in range(n_states))
    found = leaves.groupBy("node", F.floor(F.col("site") / BLOCK).alias("block")).agg(*sets, bits(F.col("mask") != 0).alias("seen"))
    return found.select("node", "block", *(F.col(f"m{k}").bitwiseOR(F.bitwise_not("seen")).alias(f"m{k}") for k in range(n_states)), "seen")


def _fitch_node(n_states: int) -> State:
    """Left fold in child order: the intersection where there is one, else the union and a step more, for all sites of a block at once."""
    names = [f"m{k}" for k in range(n_states)]
    children = F.array_sort(F.collect_list(F.struct("ord", F.array(*names).alias("m"))))
    every = F.array(*(F.lit(-1).cast("long") for _ in names))
    start = F.struct(every.alias("m"), F.array().cast("array<bigint>").alias("steps"))

    def merge(a: Column, x: Column) -> Column:
        both = F.zip_with(a["m"], x["m"], lambda p, q: p.bitwiseAND(q))
        apart = F.bitwise_not(F.aggregate(both, F.lit(0).cast("long"), lambda p, q: p.bitwiseOR(q)))
        either = F.zip_with(a["m"], x["m"], lambda p, q: p.bitwiseOR(q).bitwiseAND(apart))
        return F.struct(F.zip_with(both, either, lambda p, q: p.bitwiseOR(q)).alias("m"), F.array_append(a["steps"], apart).alias("steps"))

    found = F.aggregate(children, start, merge)
    own = F.filter(found["steps"], lambda u: u != 0)
    below = F.flatten(F.collect_list("steps"))
    return {n: found["m"][k] for k, n in enumerate(names)} | {"seen": F.bit_or("seen"), "steps": F.concat(below, own)}


def fitch_blocks(tree: DataFrame, leaves: DataFrame, n_states: int = 4, root_only: bool = False) -> DataFrame:
    """Fitch's fold over blocks of 64 sites: ``[tree,] node, site`` (the block), ``m0 .., seen``, and ``steps``, one long of bits for each step below."""
    start = site_sets(leaves, n_states).withColumnRenamed("block", "site").withColumn("steps", F.array().cast("array<bigint>"))
    return fold_up(tree, start, lambda: _fitch_node(n_states), root_only=root_only)


def fitch(tree: DataFrame, leaves: DataFrame, root_only: bool = False, n_states: int = 4) -> DataFrame:
    """``[tree,] node, site, mask, steps`` of all nodes, or of the root, at the sites that a tip below has; ``leaves``: ``node, site, mask``. The root's steps are the site's score."""
    blocks = fitch_blocks(tree, leaves, n_states, root_only)
    at = blocks.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).where("getbit(seen, bit) = 1")
    mask = sum((F.getbit(f"m{k}", F.col("bit")).cast("int") * (1 << k) for k in range(n_states)), F.lit(0))
    steps = F.aggregate("steps", F.lit(0).cast("long"), lambda n, u: n + F.getbit(u, F.col("bit")))
    site = (F.col("site") * BLOCK + F.col("bit")).cast(leaves.schema["site"].dataType)
    return at.select(*keys(tree), "node", site.alias("site"), mask.alias("mask"), steps.alias("steps"))


def fitch_scores(tree: DataFrame, leaves: DataFrame, n_states: int = 4) -> DataFrame:
    """``[tree,] steps, sites`` summed over all sites of each tree, without a row for a site."""
    roots = fitch_blocks(tree, leaves, n_states, root_only=True)
    steps = F.aggregate("steps", F.lit(0).cast("long"), lambda n, u: n + F.bit_count(u))
    return roots.groupBy(*keys(tree)).agg(F.sum(steps).alias("steps"), F.sum(F.bit_count("seen")).alias("sites"))


def fitch_ancestors(tree: DataFrame, up: DataFrame) -> DataFrame:
    """Second pass, from the root: a node's set within its parent's, or its own if they share nothing."""
    key, height = keys(tree), height_of(tree)
    edges = counted(tree.select(*key, "node", "parent", "level"))
    current = up.join(edges.where("level = 0"), [*key, "node"]).select(*key, "node", "site", F.col("mask").alias("final"))
    done = current
    for level in range(1, height + 1):
        above = current.select(*key, F.col("node").alias("parent"), "site", F.col("final").alias("p"))
        joined = up.join(edges.where(F.col("level") == level), [*key, "node"]).join(above, [*key, "parent", "site"])
        both = F.col("mask").bitwiseAND(F.col("p"))
        current = joined.select(*key, "node", "site", F.when(both != 0, both).otherwise(F.col("mask")).alias("final"))
        done = done.unionByName(current)
    return done


def camin_sokal(tree: DataFrame, leaves: DataFrame, root_only: bool = False) -> DataFrame:
    """Irreversible 0 to 1: ``node, site, state, steps``; ``leaves``: ``node, site, state``. Where children differ, each that is 1 is a gain."""

    def combine() -> State:
        low, high = F.min("state"), F.sum("state")
        return {"state": low, "steps": F.sum("steps") + F.when(low == 1, F.lit(0)).otherwise(high)}

    return fold_up(tree, leaves.withColumn("steps", F.lit(0).cast("long")), combine, root_only=root_only)


def dollo(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """One gain, at the least common ancestor of all tips with state 1, and the fewest losses: ``site, gains, losses``.

    Carried up: the tips with 1 below, the losses if the node is 1, and the losses in the clade if the gain lies in it.
    """
    total = leaves.groupBy("site").agg(F.sum("state").cast("long").alias("all"))

    def combine() -> State:
        n, lost = F.sum("ones"), F.sum(F.when(F.col("ones") == 0, 1).otherwise(F.col("losses")))
        whole = F.max(F.when(F.col("ones") == F.col("all"), F.col("best")))
        return {"ones": n, "losses": lost.cast("long"), "best": F.coalesce(whole, lost.cast("long"))}

    start = leaves.join(total, "site").select("node", "site", "all", F.col("state").cast("long").alias("ones"), F.lit(0).cast("long").alias("losses"), F.lit(0).cast("long").alias("best"))
    found = fold_up(tree, start, combine, carry=("all",), root_only=True)
    any_one = F.col("all") > 0
    return found.select(*keys(tree), "site", any_one.cast("long").alias("gains"), F.when(any_one, F.col("best")).otherwise(0).alias("losses"))


def sankoff(tree: DataFrame, leaves: DataFrame, costs: DataFrame) -> DataFrame:
    """Least cost of each site at the root: ``[tree,] site, cost``. ``leaves``: ``node, site, state`` observed; ``costs``: ``s, r, step``, every pair of states.

    A row holds the costs of all states above a node's branch in columns of its own, so there is no row for each state; a branch is a
    min-plus product with the matrix of steps, which comes to the driver (states squared). A leaf's costs above it are a row of that matrix.
    """
    key, shape = keys(tree), Shape(tree)
    table = {(r.s, r.r): int(r.step) for r in costs.select("s", "r", "step").collect()}
    states = sorted({a for a, _ in table})
    names = [f"c{k}" for k in range(len(states))]
    place = F.array_position(F.array(*map(F.lit, states)), F.col("state")).cast("int")
    seen = [F.element_at(F.array(*(F.lit(table[a, b]).cast("long") for b in states)), place).alias(n) for a, n in zip(states, names, strict=True)]
    moved = [F.least(*(F.col(m) + F.lit(table[a, b]) for b, m in zip(states, names, strict=True))) if len(states) > 1 else F.col(names[0]) for a in states]
    edges = tree.select(*key, "node", "parent", "level")
    tips = leaves.join(shape.side(edges), "node").select(*key, "parent", "level", "site", *seen)
    current = None
    for level in range(shape.height, 0, -1):
        own = tips.where(F.col("level") == level).drop("level")
        if current is not None:
            above = current.join(shape.side(edges.where(F.col("level") == level)), [*key, "node"])
            own = own.unionByName(above.select(*key, "parent", "site", *(c.alias(n) for c, n in zip(moved, names, strict=True))))
        current = own.groupBy(*key, F.col("parent").alias("node"), "site").agg(*(F.sum(n).alias(n) for n in names))
    return current.select(*key, "site", (F.least(*names) if len(names) > 1 else F.col(names[0])).alias("cost"))


def root_likelihoods(tree: DataFrame, leaves: DataFrame, rates: tuple[float, ...] = (1.0,), frequencies: tuple[float, ...] = (0.25,) * 4, speed: float = 4 / 3) -> DataFrame:
    """Likelihoods at the root: ``[tree,] site, rate, mean, scale``, ``mean`` times ``exp(scale)``, where a state stays with probability ``exp(-speed rate t)`` and is drawn anew by its frequency
    otherwise: JC69 by default, the Poisson model of proteins with twenty frequencies and speed 1. ``leaves``: ``node, site`` and the observed ``state``, or a ``mask`` of
    the states that it may be. Nodes without data give no factor. All rates go up together, and each level is scaled to a greatest likelihood of 1."""
    e = F.exp(-speed * F.col("rate") * F.greatest("bl", F.lit(1e-8)))
    names = [f"l{k}" for k in range(len(frequencies))]

    def combine() -> State:
        return {n: F.product((1 - e) * F.col("mean") + e * F.col(n)) for n in names} | {"scale": F.sum("scale")}

    def averaged(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("mean", sum((f * F.col(n) for f, n in zip(frequencies[1:], names[1:], strict=True)), frequencies[0] * F.col(names[0])))

    def scaled(nodes: DataFrame) -> DataFrame:
        top = F.greatest(*names)
        fit = F.when(top > 0, top).otherwise(1.0)
        kept = [c for c in nodes.columns if c not in (*names, "scale")]
        return averaged(nodes.select(*kept, *((F.col(n) / fit).alias(n) for n in names), (F.col("scale") + F.log(fit)).alias("scale")))

    known = (lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) > 0) if "mask" in leaves.columns else (lambda k: F.col("state") == k)
    spread = leaves.withColumn("rate", F.explode(F.array(*map(F.lit, rates)))) if len(rates) > 1 else leaves.withColumn("rate", F.lit(rates[0]))
    start = spread.select("node", "site", "rate", *(known(k).cast("double").alias(n) for k, n in enumerate(names)), F.lit(0.0).alias("scale"))
    found = fold_up(tree, averaged(start), combine, ("rate",), scaled, root_only=True)
    return found.select(*keys(tree), "site", "rate", "mean", "scale")


def site_likelihoods(tree: DataFrame, leaves: DataFrame, rates: tuple[float, ...] = (1.0,), **model) -> DataFrame:
    """``[tree,] site, lnl``: the log of the mean over equally likely rates of the root's likelihood, summed without leaving the log scale. ``model``: as for :func:`root_likelihoods`."""
    root = root_likelihoods(tree, leaves, rates, **model)
    own = root.select(*keys(tree), "site", (F.log("mean") + F.col("scale")).alias("x"))
    if len(rates) == 1:
        return own.select(*keys(tree), "site", F.round("x", 6).alias("lnl"))
    listed = own.groupBy(*keys(tree), "site").agg(F.collect_list("x").alias("x"))  # one for each rate
    top = F.array_max("x")
    total = F.aggregate(F.transform("x", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    return listed.select(*keys(tree), "site", F.round(top + F.log(total / len(rates)), 6).alias("lnl"))


def ancestors(tree: DataFrame) -> DataFrame:
    """``node, above, dist, depth`` for each node and itself or an ancestor; ``dist``: the branch lengths between."""
    height = height_of(tree)
    edges = counted(tree.select(F.col("node").alias("above"), F.col("parent").alias("up"), F.col("bl").alias("step")))
    current = tree.select("node", F.col("node").alias("above"), F.lit(0.0).alias("dist"), F.lit(0).alias("depth"))
    done = current
    for _ in range(height):
        current = current.join(edges, "above").where("up is not null").select("node", F.col("up").alias("above"), (F.col("dist") + F.col("step")).alias("dist"), (F.col("depth") + 1).alias("depth"))
        done = done.unionByName(current)
    return done


def patristic(tree: DataFrame) -> DataFrame:
    """``i < j, d`` of all pairs of leaves: the least sum of distances to a common ancestor."""
    leaves = tree.select("node").join(tree.select(F.col("parent").alias("node")), "node", "left_anti")
    paths = ancestors(tree).join(leaves, "node", "left_semi")
    x, y = paths.select(F.col("node").alias("i"), "above", F.col("dist").alias("a")), paths.select(F.col("node").alias("j"), "above", F.col("dist").alias("b"))
    return x.join(y, "above").where("i < j").groupBy("i", "j").agg(F.round(F.min(F.col("a") + F.col("b")), 6).alias("d"))


def lca(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``i, j, lca`` for pairs of nodes: the deepest common ancestor."""
    up = ancestors(tree).select("node", "above", "depth")
    x, y = up.select(F.col("node").alias("i"), "above", F.col("depth").alias("di")), up.select(F.col("node").alias("j"), "above")
    return pairs.join(x, "i").join(y, ["j", "above"]).groupBy("i", "j").agg(F.min_by("above", "di").alias("lca"))


def heights(tree: DataFrame) -> DataFrame:
    """``node, height``: the longest way down to a leaf; and ``to_root``."""
    up = ancestors(tree)
    down = up.groupBy(F.col("above").alias("node")).agg(F.round(F.max("dist"), 6).alias("height"))
    root = up.groupBy("node").agg(F.round(F.max("dist"), 6).alias("to_root"))
    return down.join(root, "node")


def tree_contrasts(tree: DataFrame, traits: DataFrame) -> DataFrame:
    """Independent contrasts on any binary tree: ``char, k, contrast, variance`` of each inner node ``k``. ``traits``: ``node, char, value`` of the tips.

    A node's state is the inverse-variance mean of what its two branches bring, and the variance it adds to its own branch; the first child by
    ``ord`` comes first. Standardised contrasts are divided by the root of their variance.
    """

    def combine() -> State:
        side = lambda c, k: F.max(F.when(F.col("ord") == k, F.col(c)))
        x, y = side("x", 0), side("x", 1)
        v, w = (F.max(F.when(F.col("ord") == k, F.col("bl") + F.col("extra"))) for k in (0, 1))
        return {"x": (x / v + y / w) / (1 / v + 1 / w), "extra": v * w / (v + w), "contrast": (x - y) / F.sqrt(v + w), "variance": v + w}

    none = F.lit(None).cast("double")
    start = traits.select("node", F.col("char").alias("site"), F.col("value").alias("x"), F.lit(0.0).alias("extra"), none.alias("contrast"), none.alias("variance"))
    found = fold_up(tree, start, combine)
    return found.where("contrast is not null").select(F.col("site").alias("char"), F.col("node").alias("k"), "contrast", "variance")


def brownian_lnl(contrasts: DataFrame) -> DataFrame:
    """``char, rate, lnl``: the most likely rate of Brownian motion and the restricted log-likelihood there, of each character."""
    n = F.count("*")
    rate = F.sum(F.col("contrast") * F.col("contrast")) / n
    lnl = -0.5 * (n * F.log(F.lit(2 * math.pi)) + F.sum(F.log("variance")) + n * F.log(rate) + n)
    return contrasts.groupBy("char").agg(F.round(rate, 8).alias("rate"), F.round(F.when(rate > 0, lnl), 6).alias("lnl"))


def contrast_correlations(contrasts: DataFrame) -> DataFrame:
    """``a < b, r``: correlations of two characters' contrasts through the origin."""
    x, y = contrasts.select(F.col("char").alias("a"), "k", F.col("contrast").alias("x")), contrasts.select(F.col("char").alias("b"), "k", F.col("contrast").alias("y"))
    sums = x.join(y, "k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return sums.select("a", "b", F.round(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("r"))
