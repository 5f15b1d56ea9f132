"""Queries whose inner work is a NumPy kernel: one group of rows (a matrix, an alignment, a replicate) per call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import encode as E
from ..functions import clustering as C
from ..functions import likelihood as L
from ..functions import parsimony as M
from ..functions.newick import split_sets, write
from ..operators import distances as D
from ..operators import resampling as R
from .book import add
from .sequence import region_sites


def _matrix(s, d):
    return D.distances(D.pair_counts(E.sites(s, d)), D.jc69()).withColumn("aln", F.lit("sites"))


for method in C.METHODS:
    add(f"{method}_tree", lambda s, d, m=method: C.trees(_matrix(s, d), m))


def _sequences(rows: pd.DataFrame) -> dict:
    """Masks by taxon over all sites; 15 where a taxon has none."""
    wide = rows.assign(mask=np.left_shift(1, rows["state"].to_numpy())).pivot(index="taxon", columns="site", values="mask").fillna(15).astype(int)
    return {str(t): wide.loc[t].to_numpy() for t in wide.index}


def columns(sites):
    """``site, p``: the states of each site, by taxon, as a text."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "state"))), lambda x: F.concat_ws(":", x["taxon"].cast("string"), x["state"].cast("string"))), ",")
    return sites.groupBy("site").agg(own.alias("p"))


def _patterns(s, d, sites):
    """Column patterns ``taxon, site, state, w``: one site stands for all with the same column, so a kernel gets the distinct ones only."""
    first = columns(sites).groupBy("p").agg(F.min("site").alias("site"), F.count("*").alias("w"))
    return sites.join(first.select("site", "w"), "site").withColumn("aln", F.lit("sites"))


def _weights(rows: pd.DataFrame):
    return rows.groupby("site")["w"].first().to_numpy()


def _parsimony(key, rows):
    masks = _sequences(rows)
    tree, length = M.search(sorted(masks), masks, _weights(rows))
    return pd.DataFrame({"aln": [key[0]], "newick": [write(tree)], "steps": [length]})


def _exact(key, rows):
    masks = _sequences(rows)
    found, length = M.branch_and_bound(sorted(masks), masks, _weights(rows))
    return pd.DataFrame({"aln": [key[0]], "n_trees": [len(found)], "steps": [length]})


def _likelihood(moves):
    def run(key, rows):
        masks = _sequences(rows)
        data = L.Data.of(masks)
        data.weights = pd.Series(_weights(rows), dtype=float).groupby(data.pattern_of_site).sum().to_numpy()
        tree, value = L.ml_search(sorted(masks), data, L.Model(), moves)
        return pd.DataFrame({"aln": [key[0]], "newick": [write(tree)], "lnl": [round(value, 4)]})

    return run


add("parsimony_search", lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(_parsimony, "aln string, newick string, steps long"))
add("branch_and_bound", lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(_exact, "aln string, n_trees long, steps long"))
add("ml_search", lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(_likelihood(M.regrafts), "aln string, newick string, lnl double"))
add("nni_search", lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(_likelihood(L.nni), "aln string, newick string, lnl double"))


def _clique(key, rows):
    names = sorted(set(rows["a"]) | set(rows["b"]))
    place = {n: k for k, n in enumerate(names)}
    graph = [0] * len(names)
    for a, b in rows.loc[rows["compatible"], ["a", "b"]].itertuples(index=False):
        graph[place[a]] |= 1 << place[b]
        graph[place[b]] |= 1 << place[a]
    best, count = M.maximum_clique(graph)
    return pd.DataFrame({"size": [len(best)], "chars": [",".join(str(names[k]) for k in best)], "n_maximal": [count]})


def max_clique(s, d):
    from ..operators.sitewise import compatible_pairs

    return compatible_pairs(E.characters(s, d)).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(_clique, "size long, chars string, n_maximal long")


add("max_clique", max_clique)


def bootstrap_nj(s, d, reps: int = 20):
    """Support of the splits of neighbour-joining trees of resampled sites: replicates are groups, columns are weighted, never copied."""
    sites = E.sites(s, d)
    weights = R.bootstrap_weights(E.table(s, d, "part").select(F.col("p_partkey").alias("pos")), reps)
    same = F.col("same") / F.col("total")
    matrices = R.resampled_identity(sites, weights).select("rep", "i", "j", F.when(4 * same > 1, -0.75 * F.log((4 * same - 1) / 3)).alias("d"))

    def run(key, rows):
        names, m = C.matrix(rows)
        found = split_sets(C.neighbor_joining(names, m))
        return pd.DataFrame({"rep": key[0], "split": [",".join(sorted(x)) for x in found]})

    splits = matrices.groupBy("rep").applyInPandas(run, "rep int, split string")
    return splits.groupBy("split").agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(float(reps)), 6).alias("support"))


add("bootstrap_nj_consensus", lambda s, d: bootstrap_nj(s, d).where("support > 0.5"))
