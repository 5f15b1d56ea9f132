"""One function per task, from sequence rows ``aln_id, taxon, seq`` or Newick texts to DataFrames or plain values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import clustering, likelihood, newick, parsimony, searches
from .functions.stats import gamma_rates
from .operators import distances as D
from .operators import folds, sitewise, splits
from .operators.ml_distances import ml_distances
from .operators.newick_text import newick_texts
from .session import workers_see_package
from .sources.formats import MASKS, to_masks, to_sites


def _masks(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {r.taxon: np.array([MASKS[b] for b in r.seq.upper()]) for r in rows.itertuples()}


def _model(sequences: dict[str, np.ndarray], model: str, ratio: float, gamma: list[float] | None) -> likelihood.Model:
    rates = tuple(gamma) if gamma else (1.0,)
    if model == "jc69":
        return likelihood.Model(rates=rates)
    known = np.concatenate(list(sequences.values()))
    counts = np.array([(known == 1 << k).sum() for k in range(4)], float)
    share = counts / counts.sum() if counts.sum() else np.full(4, 0.25)
    share = np.maximum(share, 1e-6)
    return likelihood.Model(tuple((share / share.sum()).tolist()), float(likelihood.excess(share / share.sum(), ratio)), rates)


def distances(
    sequences: DataFrame, model: str = "jc69", alpha: float | None = None, frequencies: Sequence[float] | None = None, ratio: float = 2.0, fit: str = "likelihood", categories: int = 4
) -> DataFrame:
    """``aln_id, i, j, d`` of all pairs of taxa that share a known site.

    ``fit``: ``likelihood`` maximises it for each pair; ``closed`` takes the model's formula, null where it has no finite value. ``model``: ``jc69``, ``k2p``, ``f81``,
    ``f84`` or, always closed, ``logdet``. ``frequencies`` of A, C, G, T: the pair's own unless given. ``ratio``: of transitions to transversions, for likelihood.
    ``alpha``: shape of gamma-distributed rates (``categories`` of them for likelihood).
    """
    counts = D.pair_counts(to_sites(sequences), ["aln_id"])
    if model == "logdet":
        return counts.select("aln_id", "i", "j", D.logdet().alias("d"))
    if fit == "closed":
        fixed = {"frequencies": frequencies} if model in ("f81", "f84") else {}
        return counts.select("aln_id", "i", "j", D.MODELS[model](alpha, **fixed).alias("d"))
    rates = (1.0,) if alpha is None else tuple(float(r) for r in gamma_rates(alpha, categories))
    return ml_distances(counts, model, frequencies, ratio, rates, ("aln_id", "i", "j"))


def distance(sequences: DataFrame, model: str = "jc69", method: str = "nj", alpha: float | None = None, **options) -> DataFrame:
    """A tree per alignment from pairwise distances: ``aln_id, newick``. ``options``: as for :func:`distances`, which are most likely ones by default."""
    return clustering.trees(distances(sequences, model, alpha, **options), method, "aln_id")


def maximum_likelihood(sequences: DataFrame, model: str = "f84", ratio: float = 2.0, gamma: list[float] | None = None) -> DataFrame:
    """A tree per alignment by likelihood search: ``aln_id, newick, lnl``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = _masks(rows)
        tree, value = likelihood.ml_search(sorted(masks), likelihood.Data.of(masks), _model(masks, model, ratio, gamma))
        return pd.DataFrame({"aln_id": [key[0]], "newick": [newick.write(tree)], "lnl": [value]})

    workers_see_package(sequences.sparkSession)
    return sequences.groupBy("aln_id").applyInPandas(run, "aln_id string, newick string, lnl double")


def most_parsimonious(sequences: DataFrame, exact: bool = False) -> DataFrame:
    """A shortest tree per alignment: ``aln_id, newick, steps``; ``exact`` by branch and bound."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks = _masks(rows)
        if exact:
            found, steps = parsimony.branch_and_bound(sorted(masks), masks)
            tree = found[0]
        else:
            tree, steps = parsimony.search(sorted(masks), masks)
        return pd.DataFrame({"aln_id": [key[0]], "newick": [newick.write(tree)], "steps": [steps]})

    workers_see_package(sequences.sparkSession)
    return sequences.groupBy("aln_id").applyInPandas(run, "aln_id string, newick string, steps long")


def most_parsimonious_binary(sequences: DataFrame, score: str = "dollo") -> DataFrame:
    """A tree per alignment of 0/1 characters with fewest steps: ``aln_id, newick, steps``. ``score``: ``dollo`` or ``camin_sokal``; other signs count as 0."""
    steps = {"dollo": searches.dollo_steps, "camin_sokal": searches.camin_sokal_steps}[score]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = {r.taxon: np.array([int(c == "1") for c in r.seq]) for r in rows.itertuples()}
        tree, value = searches.hill_climb(sorted(states), lambda t: int(steps(t, states).sum()), rooted=True)
        return pd.DataFrame({"aln_id": [key[0]], "newick": [newick.write(tree)], "steps": [value]})

    workers_see_package(sequences.sparkSession)
    return sequences.groupBy("aln_id").applyInPandas(run, "aln_id string, newick string, steps long")


def ml_bootstrap(sequences: DataFrame, reps: int = 100, seed: int = 42, model: str = "jc69") -> DataFrame:
    """The best likelihood tree's splits and their support by likelihood searches on resampled sites: ``aln_id, split, support`` in percent."""
    spread = sequences.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks, rep = _masks(rows), int(key[1])
        data = likelihood.Data.of(masks)
        if rep:
            n = len(data.pattern_of_site)
            drawn = np.random.default_rng([seed, rep]).integers(0, n, n)
            data.weights = np.bincount(data.pattern_of_site[drawn], minlength=len(data.weights)).astype(float)
        tree, _ = likelihood.ml_search(sorted(masks), data, _model(masks, model, 2.0, None), likelihood.nni)
        splits = newick.split_sets(tree)
        return pd.DataFrame({"aln_id": key[0], "rep": rep, "split": [",".join(sorted(s)) for s in splits]})

    workers_see_package(sequences.sparkSession)
    found = spread.groupBy("aln_id", "rep").applyInPandas(run, "aln_id string, rep int, split string")
    counts = found.where("rep > 0").groupBy("aln_id", "split").agg(F.count("*").alias("n"))
    best = found.where("rep = 0").select("aln_id", "split")
    return best.join(counts, ["aln_id", "split"], "left").select("aln_id", "split", (100 * F.coalesce("n", F.lit(0)) / F.lit(float(reps))).alias("support"))


def au_confidence_set(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The trees that the approximately unbiased test does not reject. ``tests``: rows with ``au``."""
    return tests.where(F.col("au") > alpha)


def bootstrap(sequences: DataFrame, reps: int = 100, seed: int = 42, model: str = "jc69") -> DataFrame:
    """Support of splits by neighbour joining of resampled sites: ``aln_id, split, support``. Each replicate is a group of its own."""
    spread = sequences.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks, rng = _masks(rows), np.random.default_rng([seed, int(key[1])])
        names = sorted(masks)
        drawn = rng.integers(0, len(masks[names[0]]), len(masks[names[0]]))
        base, d = _model(masks, model, 2.0, None), np.zeros((len(names), len(names)))
        for i, a in enumerate(names):
            for j in range(i):
                x, y = masks[a][drawn], masks[names[j]][drawn]
                counts = np.array([[((x == 1 << p) & (y == 1 << q)).sum() for q in range(4)] for p in range(4)], float)
                d[i, j] = d[j, i] = likelihood.pair_distance(counts, base)
        splits = newick.split_sets(clustering.neighbor_joining(names, d))
        return pd.DataFrame({"aln_id": key[0], "split": [",".join(sorted(s)) for s in splits]})

    workers_see_package(sequences.sparkSession)
    found = spread.groupBy("aln_id", "rep").applyInPandas(run, "aln_id string, split string")
    return found.groupBy("aln_id", "split").agg((F.count("*") / F.lit(float(reps))).alias("support"))


def evaluate(sequences: DataFrame, tree: str, model: str = "jc69", ratio: float = 2.0, optimize: bool = True) -> DataFrame:
    """Likelihood of a given tree per alignment: ``aln_id, newick, lnl``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        masks, root = _masks(rows), newick.parse(tree)
        if odd := sorted({n.name or "" for n in root.leaves()} ^ set(masks)):
            raise ValueError(f"only in the tree or only in the alignment: {', '.join(odd[:5])}")
        data, own = likelihood.Data.of(masks), _model(masks, model, ratio, None)
        value = likelihood.optimize_lengths(root, data, own) if optimize else likelihood.lnl(root, data, own)
        return pd.DataFrame({"aln_id": [key[0]], "newick": [newick.write(root)], "lnl": [value]})

    workers_see_package(sequences.sparkSession)
    return sequences.groupBy("aln_id").applyInPandas(run, "aln_id string, newick string, lnl double")


def _named(trees: DataFrame) -> DataFrame:
    """``tree, node, parent, ord, bl, level, name`` of readable trees ``tree, newick``: tips are named by their taxa, other nodes by a sign and their number."""
    nodes = newick.explode_trees(trees)
    inner = nodes.select("tree", F.col("parent").alias("id")).where("id is not null").distinct().withColumn("inner", F.lit(True))
    label = lambda c: F.concat(F.lit("#"), F.col(c).cast("string"))
    own = F.when(F.col("inner"), label("id")).otherwise(F.coalesce("name", F.lit("")))
    return nodes.join(inner, ["tree", "id"], "left").select("tree", own.alias("node"), label("parent").alias("parent"), "ord", F.coalesce("bl", F.lit(0.1)).alias("bl"), "level", "name")


def score_trees(sequences: DataFrame, trees: DataFrame, score: str = "parsimony", rates: Sequence[float] = (1.0,)) -> DataFrame:
    """All ``trees`` (``tree, newick``) over one alignment's sequences in one job: ``tree, steps, sites``, or ``tree, lnl, sites`` by JC69 for ``likelihood``.

    Ambiguous bases count as what they may be. A missing branch length is 0.1. A tree whose tips aren't the alignment's taxa is a ``ValueError``, as are unreadable trees.
    """
    bad = trees.join(newick.explode_trees(trees).select("tree").distinct(), "tree", "left_anti").limit(5).collect()
    if bad:
        raise ValueError(f"unreadable trees: {', '.join(str(r.tree) for r in bad)}")
    forest = _named(trees).drop("name")
    folds.check_tips(forest, sequences.select(F.col("taxon").alias("node")))
    leaves = to_masks(sequences).select(F.col("taxon").alias("node"), "site", "mask")
    if score == "parsimony":
        return folds.fitch_scores(forest, leaves)
    return folds.site_likelihoods(forest, leaves, tuple(rates)).groupBy("tree").agg(F.sum("lnl").alias("lnl"), F.count("*").alias("sites"))


def consensus(trees: DataFrame, method: str = "majority", threshold: float = 0.5) -> DataFrame:
    """One row ``newick``: the consensus of trees ``tree, newick`` of the same taxa (at most 63), with support as labels and mean lengths of inner branches.

    ``method``: ``strict``, ``majority``, ``threshold`` or ``extended``. Trees of different taxa are a ``ValueError``.
    """
    nodes = _named(trees)
    tips = folds.tips_of(nodes)
    names = sorted(r.node for r in tips.select("node").distinct().limit(64).collect())  # a bit each
    if len(names) > 63:
        raise ValueError("splits hold up to 63 taxa")
    bits = trees.sparkSession.createDataFrame([(n, 1 << k) for k, n in enumerate(names)], "node string, mask long")
    leaves = tips.join(F.broadcast(bits), "node").select("tree", "node", F.lit(0).alias("site"), "mask")
    masks = folds.fold_up(nodes, leaves, lambda: {"mask": F.bit_or("mask")}).join(nodes.select("tree", "node", "bl", "level"), ["tree", "node"])
    splits.check_taxa(masks)
    found = splits.consensus(splits.canonical(masks.where("level > 0").select("tree", "mask", "bl"), len(names)), method, threshold, len(names))
    made = splits.consensus_tree(found, len(names))
    labelled = made.join(F.broadcast(bits.select(F.col("mask").alias("node"), F.col("node").alias("name"))), "node", "left")
    label = F.coalesce("name", F.when(F.col("support").isNotNull(), F.format_string("%.2f", "support")))
    return newick_texts(labelled.select("node", "parent", F.col("node").alias("ord"), F.when(F.col("parent").isNotNull(), label).alias("name"), "bl"))


def tree_distance(a: str, b: str) -> dict[str, float]:
    """Robinson-Foulds distance, the same over its maximum, and the branch-score distance over inner branches."""
    x, y = (newick.split_sets(newick.parse(t)) for t in (a, b))
    n = len(newick.parse(a).leaves())
    rf = len(x.keys() ^ y.keys())
    return {"rf": rf, "nrf": rf / (2 * (n - 3)) if n > 3 else 0.0, "bsd": sum((x.get(s, 0) - y.get(s, 0)) ** 2 for s in x.keys() | y.keys()) ** 0.5}


def invariants(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transversion support and purine-pyrimidine invariants of all quartets of one alignment's taxa."""
    sites = to_sites(sequences)
    return sitewise.lake_support(sites), sitewise.cavender(sites)


def compatibility(sequences: DataFrame) -> DataFrame:
    """Pairs of an alignment's sites, as binary characters, and whether they fit one tree."""
    return sitewise.compatible_pairs(sitewise.majority_characters(to_sites(sequences)))


def _json(found: DataFrame, name: str) -> DataFrame:
    """``aln_id, json`` of results with one row for each alignment, or the rows of each as a list under ``name``."""
    rest = [c for c in found.columns if c != "aln_id"]
    if name:
        found = found.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        rest = [name]
    return found.select("aln_id", F.to_json(F.struct(*rest)).alias("json"))


def json_call(call: str, sequences: DataFrame, **options) -> DataFrame:
    """``aln_id, json``: the answer to a call for every alignment, as a service gives it.

    ``call``: ``neighbor_joining`` (options of :func:`distance`) and ``parsimony`` give ``newick`` (and ``steps``), ``likelihood`` (of a ``tree``) ``newick`` and ``lnl``,
    ``bootstrap`` the list ``splits`` with their support, and ``quartets`` how many sites of each four taxa support which tree, as for :func:`invariants`, where long branches
    mislead parsimony.
    """
    if call == "quartets":
        each = sequences.select("aln_id").distinct().limit(2).collect()
        if len(each) > 1:
            raise ValueError("quartets are of one alignment")
        support = invariants(sequences)[0].withColumn("aln_id", F.lit(each[0].aln_id if each else None).cast("string"))
        return _json(support, "quartets")
    calls = {
        "neighbor_joining": lambda: _json(distance(sequences, method="nj", **options), ""),
        "parsimony": lambda: _json(most_parsimonious(sequences, **options), ""),
        "likelihood": lambda: _json(evaluate(sequences, **options), ""),
        "bootstrap": lambda: _json(bootstrap(sequences, **options), "splits"),
    }
    if call not in calls:
        raise ValueError(f"no call: {call}")
    return calls[call]()
