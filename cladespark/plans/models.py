"""Queries with likelihood, dating, area and reconciliation kernels over the regions' sequences and the nations' frequencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import encode as E
from ..functions import biogeography as B
from ..functions import clustering as C
from ..functions import comparative as Y
from ..functions import likelihood as L
from ..functions import stats
from ..functions.newick import write
from ..operators import distances as D
from ..operators import multiscale
from ..operators.ml_distances import ml_distances
from ..operators.running import running_sum
from ..operators.sides import tasks_for
from ..session import cut
from .kernels import _patterns, _sequences, _weights, columns
from .book import add
from .sequence import region_sites
from .trees import _by_tree


def _data(rows: pd.DataFrame) -> tuple[list[str], L.Data]:
    masks = _sequences(rows)
    data = L.Data.of(masks)
    data.weights = pd.Series(_weights(rows), dtype=float).groupby(data.pattern_of_site).sum().to_numpy()
    return sorted(masks), data


def _start(names: list[str], data: L.Data):
    """Neighbour joining of likelihood distances, rooted as it comes."""
    d = np.zeros((len(names), len(names)))
    known = {n: x * (x.sum(1) == 1)[:, None] for n, x in data.tips.items()}
    for i, a in enumerate(names):
        for j in range(i):
            counts = (known[a] * data.weights[:, None]).T @ known[names[j]]
            d[i, j] = d[j, i] = L.pair_distance(counts, L.Model())
    return C.neighbor_joining(names, d), d


def _grouped(run, schema: str):
    return lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(run, schema)


ML_DISTANCE_SQL = f"""WITH {E.SALES_SQL}, regions AS (SELECT DISTINCT region AS taxon, site, ((site + CASE WHEN rq % 4 = 0 THEN 1 + (rq // 4) % 3 ELSE 0 END) % 4)::INTEGER AS state FROM sales),
p AS (SELECT x.taxon AS i, y.taxon AS j, avg((x.state <> y.state)::INTEGER) AS p FROM regions x JOIN regions y ON x.site = y.site AND x.taxon < y.taxon GROUP BY ALL)
SELECT i::VARCHAR AS i, j::VARCHAR AS j, round(-0.75e0 * ln(1 - 4 * p / 3), 4) AS d FROM p"""


def ml_distance(s, d):
    found = ml_distances(D.pair_counts(region_sites(s, d)))
    return found.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.round("d", 4).alias("d"))


add("ml_distance", ml_distance, ML_DISTANCE_SQL)


def _select(rows: pd.DataFrame) -> pd.DataFrame:
    names, data = _data(rows)
    pi = sum((data.tips[n] * data.weights[:, None]).sum(0) for n in names)
    pi = tuple((pi / pi.sum()).tolist())
    models = {"jc69": (L.Model(), 0)} | {f"f84-{r}": (L.Model(pi, float(L.excess(pi, r))), 4) for r in (1, 2, 4)}
    return pd.DataFrame(L.select_model(_start(names, data)[0], data, models)).round(4)


add("select_model", _grouped(_select, "model string, lnl double, k long, aic double, aicc double, bic double, weight double"))


def _shape(rows: pd.DataFrame) -> pd.DataFrame:
    names, data = _data(rows)
    tree, _ = _start(names, data)
    L.optimize_lengths(tree, data, L.Model())
    alpha, value = L.gamma_shape(tree, data, L.Model())
    return pd.DataFrame({"alpha": [round(alpha, 4)], "lnl": [round(value, 4)]})


add("gamma_shape", _grouped(_shape, "alpha double, lnl double"))


def _clock(rows: pd.DataFrame) -> pd.DataFrame:
    names, data = _data(rows)
    free, d = _start(names, data)
    best = L.optimize_lengths(free, data, L.Model())
    tree = C.upgma(names, d)
    value = Y.clock_lengths(tree, data, L.Model())
    test, p = stats.likelihood_ratio_test(value, best, len(names) - 2)
    return pd.DataFrame({"newick": [write(tree)], "lnl": [round(value, 4)], "free_lnl": [round(best, 4)], "lrt": [round(test, 4)], "p": [round(p, 6)]})


add("clock_ml", _grouped(_clock, "newick string, lnl double, free_lnl double, lrt double, p double"))


def _dated(rows: pd.DataFrame) -> pd.DataFrame:
    names, data = _data(rows)
    tree = C.upgma(names, _start(names, data)[1])
    value, rate, _ = Y.date_tree(tree, data, L.Model(), {n: float(k) for k, n in enumerate(names)}, rounds=5)
    return pd.DataFrame({"lnl": [round(value, 4)], "rate": [rate], "newick": [write(tree)]})


add("tip_dates", _grouped(_dated, "lnl double, rate double, newick string"))


def au_test(s, d):
    return multiscale.au_test(_by_tree(s, d), reps=500)


add("au_test", au_test)


PLATO_SITES = 1 << 14


def plato_bootstrap(s, d, reps: int = 20, size: int = 50, block: int = PLATO_SITES):
    """How often simulated alignments have a window as unlikely as the observed one.

    The tree and the likelihoods come from the counts of the distinct columns of five regions, of which there is a bounded number. Windows are summed in blocks of
    sites, those of the observed alignment in the order of its sites; a simulated block makes only its own sites, from its place in the replicate's random numbers.
    """
    sites = cut(columns(region_sites(s, d)))
    known = sites.groupBy("p").agg(F.count("*").alias("w")).toPandas()
    if known.empty:
        return s.createDataFrame([], "observed double, p double")
    found = [dict(x.split(":") for x in p.split(",")) for p in known["p"]]
    names, w = sorted({t for c in found for t in c}), known["w"].to_numpy(float)
    data = L.Data.of({t: np.array([1 << int(c[t]) if t in c else 15 for c in found]) for t in names})
    data.weights = np.bincount(data.pattern_of_site, w, len(data.weights))
    tree, _ = _start(names, data)
    lnl = L.pattern_lnl(tree, data, L.Model())[data.pattern_of_site]
    n = int(w.sum())
    width = min(size, n)
    for node in tree.postorder():
        node.length = max(node.length or 0.0, 1e-6)

    def lowest(site: np.ndarray) -> float | None:
        return float(np.convolve(site, np.ones(width), "valid").min()) if len(site) >= width else None

    def observe(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"low": [lowest(rows.sort_values("at")["lnl"].to_numpy())]})

    table = s.createDataFrame(pd.DataFrame({"p": known["p"], "lnl": lnl}))
    placed = running_sum(sites.join(F.broadcast(table), "p").select("site", "lnl", F.lit(1).alias("one")), "one", "site").select((F.col("total") - 1).alias("at"), "lnl")
    of = lambda at: F.floor(F.greatest(at, F.lit(0)) / block)
    spread = placed.withColumn("block", F.explode(F.sequence(of(F.col("at") - (width - 1)), of(F.col("at")))))
    observed = spread.groupBy("block").applyInPandas(observe, "low double").agg((F.min("low") - float(width * (lnl @ w) / n)).alias("observed"))
    blocks = -(-n // block)

    def simulated(batches):
        for ids in batches:
            out = []
            for k in ids["id"]:
                rep, first = int(k) // blocks + 1, int(k) % blocks * block
                made = L.Data.of(L.simulate(tree, n, L.Model(), rep, (first, min(n, first + block + width - 1))))
                site = L.pattern_lnl(tree, made, L.Model())[made.pattern_of_site]
                out.append((rep, lowest(site), float(site[:block].sum())))
            yield pd.DataFrame(out, columns=["rep", "low", "total"])

    cells = s.range(reps * blocks).repartition(tasks_for(s, reps * blocks, 32), "id").mapInPandas(simulated, "rep int, low double, total double")
    lows = cells.groupBy("rep").agg((F.min("low") - width * F.sum("total") / n).alias("low"))
    return lows.join(F.broadcast(observed)).groupBy("observed").agg(F.avg((F.col("low") <= F.col("observed")).cast("double")).alias("p")).select(F.round("observed", 4).alias("observed"), "p")


add("plato_bootstrap", plato_bootstrap)


def _frequency_matrix(s, d, method: str):
    return D.gene_frequency_distances(E.frequencies(s, d), method).select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), "d", F.lit(method).alias("method"))


def area_histories(s, d):
    """Least-cost area histories on the average-linkage tree of populations. A nation lives in its region, and in the area that its key modulo 5 names."""
    nation = E.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("i"), F.col("n_regionkey").alias("r"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = C.upgma(*C.matrix(left))
        areas = {r.i: (1 << int(r.r)) | (1 << int(r.i) % 5) for r in right.itertuples()}
        cost, best = B.area_histories(tree, areas, 5)
        return pd.DataFrame({"cost": [cost], "n_nodes": [len(best)], "root": [",".join(map(str, best[tree]))]})

    x = _frequency_matrix(s, d, "nei").withColumn("g", F.lit(1)).groupBy("g")
    return x.cogroup(nation.withColumn("g", F.lit(1)).groupBy("g")).applyInPandas(run, "cost double, n_nodes long, root string")


add("area_histories", area_histories)


def reconciliation(s, d):
    """Events when the populations' tree by one distance is mapped into their tree by another."""
    both = _frequency_matrix(s, d, "nei").unionByName(_frequency_matrix(s, d, "chord")).withColumn("g", F.lit(1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        host, parasite = (C.upgma(*C.matrix(rows[rows["method"] == m])) for m in ("nei", "chord"))
        events, cost = B.reconcile(host, parasite, {n.name: n.name for n in parasite.leaves()})
        return pd.DataFrame([{"event": k, "n": v, "cost": cost} for k, v in sorted(events.items())])

    return both.groupBy("g").applyInPandas(run, "event string, n long, cost double")


add("reconcile_events", reconciliation)


def continuous_lnl(s, d):
    """Brownian likelihood of the labels' mean embeddings on their average-linkage tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="taxon", columns="char", values="value")
        values = {str(t): wide.loc[t].to_numpy() for t in wide.index}
        names = sorted(values)
        d = np.array([[np.square(values[a] - values[b]).mean() for b in names] for a in names])
        tree = C.upgma(names, d)
        for node in tree.postorder():
            node.length = max(node.length or 0.0, 1e-6)
        value, rates = Y.brownian_lnl(tree, values)
        return pd.DataFrame({"lnl": [round(value, 4)], "mean_rate": [round(float(rates.mean()), 6)], "newick": [write(tree)]})

    return E.traits(s, d).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "lnl double, mean_rate double, newick string")


add("continuous_lnl", continuous_lnl)
