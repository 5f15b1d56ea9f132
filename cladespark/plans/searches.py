"""Queries that search trees under other scores than Fitch's, resample likelihood trees, and run simulation experiments.

Starts of a search, replicates and cells of an experiment are groups, so they run in parallel; inside a group the work is a NumPy kernel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import encode as E
from ..functions import clustering as C
from ..functions import comparative as Y
from ..functions import likelihood as L
from ..functions import parsimony as M
from ..functions import searches as X
from ..functions import stats
from ..functions.newick import Node, parse, robinson_foulds, split_sets, write
from ..operators import folds as T
from ..operators import resampling as R
from ..operators.sides import tasks_for
from ..operators.sitewise import compatible_pairs
from ..session import cut, workers_see_package
from .book import add
from .kernels import _patterns
from .models import _data, _start
from .sequence import region_sites
from .trees import FITCH_SQL, _masks, _protein_costs

STARTS = 2


def addition_orders(taxa: DataFrame, starts: int = STARTS) -> DataFrame:
    """``start, taxon, place``: seeded orders in which searches add taxa, by a hash; start 0 is the order of the names."""
    order = F.when(F.col("start") == 0, F.lit("")).otherwise(F.md5(F.concat_ws(":", F.col("start").cast("string"), F.col("taxon").cast("string"))))
    listed = taxa.select("taxon").distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("hash", order)
    ranked = listed.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("hash", "taxon"))).alias("t"))  # taxa of one tree
    return ranked.select("start", F.posexplode("t").alias("place", "t")).select("start", F.col("t.taxon").alias("taxon"), "place")


def _best_of_starts(columns: DataFrame, search: Callable[[list[str], dict[str, np.ndarray]], tuple[Node, float]], sign: int = 1) -> DataFrame:
    """``newick, score`` of the best start (ties: the least). ``columns``: ``taxon, char, state``, null or absent where unknown."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [str(t) for t in rows.sort_values("place")["taxon"].unique()]
        wide = rows.pivot(index="taxon", columns="char", values="state")
        tree, score = search(names, {str(t): wide.loc[t].to_numpy(float) for t in wide.index})
        return pd.DataFrame({"start": [int(key[0])], "newick": [write(tree)], "score": [int(sign * score)]})

    spread = columns.join(F.broadcast(addition_orders(columns)), "taxon")
    found = spread.groupBy("start").applyInPandas(run, "start int, newick string, score long")
    return found.agg(F.min_by(F.struct("newick", "score"), F.struct((sign * F.col("score")).alias("s"), "start")).alias("b")).select("b.*")


def _bits(states: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Masks of states; all ``n`` bits where a state is unknown."""
    return {t: np.where(np.isnan(v), (1 << n) - 1, np.left_shift(1, np.nan_to_num(v).astype(np.int64))) for t, v in states.items()}


def _binary(states):
    return {t: np.nan_to_num(v).astype(np.int64) for t, v in states.items()}


def _chars(s, d):
    return E.characters(s, d)


def dollo_search(s, d):
    """A tree of the nations with fewest gains and losses, each character being gained once."""
    return _best_of_starts(_chars(s, d), lambda names, v: X.hill_climb(names, lambda t, b=_binary(v): int(X.dollo_steps(t, b).sum()), rooted=True))


def camin_sokal_search(s, d):
    """A tree of the nations with fewest irreversible changes."""
    return _best_of_starts(_chars(s, d), lambda names, v: X.hill_climb(names, lambda t, b=_binary(v): int(X.camin_sokal_steps(t, b).sum()), rooted=True))


def compatibility_search(s, d):
    """A tree of the nations with most compatible characters."""
    return _best_of_starts(_chars(s, d), lambda names, v: X.hill_climb(names, lambda t, b=_bits(v, 2): -int(X.compatible_columns(t, b).sum())), sign=-1)


def multistate(s, d) -> DataFrame:
    """Characters ``taxon, char, state`` of five states: the quantity of each size group of parts by nation; a pair without sales has no row."""
    part = E.table(s, d, "part").select("p_partkey", (F.col("p_size") % 12).alias("char"))
    sold = E.sales(s, d).join(part, F.col("site") == F.col("p_partkey")).groupBy("taxon", "char").agg(F.sum("q").alias("q"))
    return sold.select("taxon", "char", (F.col("q") % 5).cast("int").alias("state"))


def multistate_search(s, d):
    """A tree of the nations with fewest steps along the ordered states."""
    steps = np.abs(np.subtract.outer(np.arange(5), np.arange(5)))
    return _best_of_starts(multistate(s, d), lambda names, v: X.step_matrix_search(names, {t: X.leaf_costs(m, 5) for t, m in _bits(v, 5).items()}, steps))


COLUMNS = 1 << 13  #: columns in a task of a search by blocks
BLOCK = 1 << 12  #: columns that are scored at once


def step_search(columns: DataFrame, steps: np.ndarray, starts: int = STARTS, most: int = COLUMNS) -> DataFrame:
    """``newick, score`` of the best start (ties: the least) by a symmetric matrix of steps. ``columns``: ``taxon, char, state``, null or absent where unknown.

    Distinct columns and their numbers are dealt out by rows. Each round of all starts is one job: a task sums the costs of every move over its columns, and the
    driver gets the least sum of each start. Taxa are those of one tree.
    """
    s, columns = columns.sparkSession, cut(columns)
    ordered = addition_orders(columns, starts).orderBy("start", "place").collect()
    orders: dict[int, list] = {}
    for r in ordered:
        orders.setdefault(r.start, []).append(r.taxon)
    if not orders:
        return s.createDataFrame([(None, None)], "newick string, score long")
    taxa = sorted(orders[0])
    names = [f"t{k}" for k in range(len(taxa))]
    wide = columns.groupBy("char").agg(*(F.max(F.when(F.col("taxon") == t, F.col("state"))).cast("byte").alias(c) for t, c in zip(taxa, names, strict=True)))
    known = cut(wide.groupBy(*names).agg(F.count("*").alias("w")))
    dealt = cut(known.repartition(tasks_for(s, known.count(), most)))
    own = np.column_stack([steps, steps.min(1)]).astype(X.cost_type(len(taxa), steps))  # the last one: of an unknown state
    place = {start: [taxa.index(t) for t in order] for start, order in orders.items()}
    workers_see_package(s)

    def least(asked: dict[int, X.Question]) -> dict[int, tuple[int, int]]:
        def score(batches):
            sums: dict[int, np.ndarray] = {}
            for rows in batches:
                states = rows[names].fillna(len(steps)).to_numpy(np.int64)
                for first in range(0, len(rows), BLOCK):
                    weights = rows["w"].to_numpy(np.int64)[first : first + BLOCK]
                    tips = [np.ascontiguousarray(own[:, k]) for k in states[first : first + BLOCK].T]
                    for start, question in asked.items():
                        sums[start] = sums.get(start, 0) + X.StepCosts([tips[k] for k in place[start]], steps)(question, weights)
            for start, costs in sums.items():
                yield pd.DataFrame({"start": start, "at": np.arange(len(costs)), "cost": costs})

        found = dealt.mapInPandas(score, "start int, at long, cost long").groupBy("start", "at").agg(F.sum("cost").alias("cost"))
        return {r.start: (r.b["at"], r.b["cost"]) for r in found.groupBy("start").agg(F.min(F.struct("cost", "at")).alias("b")).collect()}

    moves = {start: X.step_matrix_moves(len(taxa)) for start in orders}
    asked, done = {start: next(m) for start, m in moves.items()}, []
    while asked:
        answers, questions = least(asked), {}
        for start in asked:
            try:
                questions[start] = moves[start].send(answers[start])
            except StopIteration as end:
                near, length = end.value
                done.append((length, start, write(X.as_node(near, [str(t) for t in orders[start]]))))
        asked = questions
    score, _, newick = min(done)
    return s.createDataFrame([(newick, score)], "newick string, score long")


def protein_search(s, d):
    """A tree of the nations' residues with fewest base changes by the genetic code: stepwise addition and regrafts until none gains."""
    table = np.zeros((20, 20), np.int64)
    for r in _protein_costs(s).select("s", "r", "step").collect():  # 400 rows of the code
        table[r.s, r.r] = r.step
    return step_search(E.residues(s, d).withColumnRenamed("site", "char"), table)


for name, query in (("dollo", dollo_search), ("camin_sokal", camin_sokal_search), ("compatibility", compatibility_search), ("multistate", multistate_search), ("protein_parsimony", protein_search)):
    add(f"{name}_search", query)


MULTI_SQL = f"""{E.SALES_SQL}, multi AS (SELECT taxon, region, char, (q % 5)::INTEGER AS state FROM (SELECT taxon, region, p_size % 12 AS char, sum(q) AS q FROM sales
      JOIN part ON site = p_partkey GROUP BY ALL)),
low AS (SELECT region + 100 AS node, char, list_reduce(list((1 << state)::BIGINT ORDER BY taxon), lambda a, x: CASE WHEN (a & 31 & x) > 0 THEN a - (a & 31) + (a & 31 & x) ELSE a - (a & 31) + 32 + ((a & 31) | x) END) AS c FROM multi GROUP BY ALL),
top AS (SELECT char, list_reduce(list((c & 31)::BIGINT ORDER BY node), lambda a, x: CASE WHEN (a & 31 & x) > 0 THEN a - (a & 31) + (a & 31 & x) ELSE a - (a & 31) + 32 + ((a & 31) | x) END) AS c, sum(c >> 5) AS below FROM low GROUP BY char)"""


def multistate_steps(s, d):
    """Unordered steps of each multistate character on the nations' tree; unknown states are left out, which is as good as any state."""
    leaves = multistate(s, d).select(F.col("taxon").alias("node"), F.col("char").alias("site"), F.pow(F.lit(2.0), F.col("state")).cast("int").alias("mask"))
    return T.fitch(E.tree(s, d), leaves, root_only=True, n_states=5).select(F.col("site").alias("char"), "mask", "steps")


add("multistate_steps", multistate_steps, f"WITH {MULTI_SQL} SELECT char, (c & 31)::INTEGER AS mask, ((c >> 5) + below)::BIGINT AS steps FROM top")


def compatible_sites(s, d):
    """Sites of the nations that need on their tree one step less than they have states: ``site, n_states, steps, compatible``."""
    states = E.sites(s, d).groupBy("site").agg(F.countDistinct("state").alias("n_states"))
    found = T.fitch(E.tree(s, d), _masks(s, d), root_only=True).select("site", "steps").join(states, "site")
    return found.select("site", "n_states", "steps", (F.col("steps") == F.col("n_states") - 1).alias("compatible"))


add(
    "compatible_sites",
    compatible_sites,
    f"WITH {FITCH_SQL}, n AS (SELECT site, count(DISTINCT state) AS n_states FROM sites GROUP BY site) SELECT site, n_states, ((c >> 4) + below)::BIGINT AS steps, ((c >> 4) + below) = n_states - 1 AS compatible FROM top JOIN n USING (site)",
)


def clique_tree(s, d):
    """The tree of a largest set of pairwise compatible characters."""
    pairs = compatible_pairs(E.characters(s, d))
    states = E.characters(s, d)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(left["a"]) | set(left["b"]))
        place = {n: k for k, n in enumerate(names)}
        graph = [0] * len(names)
        for a, b in left.loc[left["compatible"], ["a", "b"]].itertuples(index=False):
            graph[place[a]] |= 1 << place[b]
            graph[place[b]] |= 1 << place[a]
        best, _ = M.maximum_clique(graph)
        wide = right.pivot(index="taxon", columns="char", values="state").fillna(0).astype(int)
        taxa = [str(t) for t in wide.index]
        splits = []
        for k in best:
            column = wide[names[k]].to_numpy()
            mask = sum(1 << t for t, x in enumerate(column) if x != column[0])
            if 1 < mask.bit_count() < len(taxa) - 1:
                splits.append(mask)
        return pd.DataFrame({"size": [len(best)], "newick": [write(X.tree_of_splits(splits, taxa))]})

    one = F.lit(1).alias("g")  # characters of one data set: the graph has a row for each pair of them
    return pairs.select("*", one).groupBy("g").cogroup(states.select("*", one).groupBy("g")).applyInPandas(run, "size long, newick string")


add("clique_tree", clique_tree)


def _grouped(run, schema: str):
    return lambda s, d: _patterns(s, d, region_sites(s, d)).groupBy("aln").applyInPandas(run, schema)


def _ratio(rows: pd.DataFrame) -> pd.DataFrame:
    """The transition/transversion ratio by likelihood within 0.5 and 20, on the distance tree with its lengths optimised."""
    names, data = _data(rows)
    pi = sum((data.tips[n] * data.weights[:, None]).sum(0) for n in names)
    pi = tuple((pi / pi.sum()).tolist())
    tree, _ = _start(names, data)
    L.optimize_lengths(tree, data, L.Model(pi, 1.0))
    ratio, value = L.golden(lambda r: L.lnl(tree, data, L.Model(pi, float(L.excess(pi, r)))), 0.5, 20.0, 1e-4, 50)
    return pd.DataFrame({"ratio": [round(ratio, 4)], "lnl": [round(value, 4)]})


add("transition_ratio_ml", _grouped(_ratio, "ratio double, lnl double"))


def _date_test(rows: pd.DataFrame) -> pd.DataFrame:
    """Likelihood-ratio test of dated tips against tips of one date; one degree of freedom for each date beyond the first."""
    names, data = _data(rows)
    d = _start(names, data)[1]
    dates = {n: float(k) for k, n in enumerate(names)}
    same = Y.clock_lengths(C.upgma(names, d), data, L.Model())
    dated, rate, _ = Y.date_tree(C.upgma(names, d), data, L.Model(), dates)
    test, p = stats.likelihood_ratio_test(same, dated, len(set(dates.values())) - 1)
    return pd.DataFrame({"lnl": [round(dated, 4)], "same_date_lnl": [round(same, 4)], "rate": [round(rate, 6)], "lrt": [round(test, 4)], "p": [round(p, 6)]})


add("tip_date_test", _grouped(_date_test, "lnl double, same_date_lnl double, rate double, lrt double, p double"))


def ml_bootstrap(s, d, reps: int = 10):
    """Support of the splits of the best likelihood tree by searches on resampled sites: replicates are groups, columns are weighted, never copied."""
    sites = region_sites(s, d)
    weights = R.bootstrap_weights(E.table(s, d, "part").select(F.col("p_partkey").alias("pos")), reps).select("rep", F.col("pos").alias("site"), "w")
    own = sites.select(F.lit(0).alias("rep"), "site").distinct().withColumn("w", F.lit(1).cast("long"))
    column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "state"))), lambda x: F.concat_ws(":", x["taxon"].cast("string"), x["state"].cast("string"))), ",")
    patterns = sites.groupBy("site").agg(column.alias("p"))
    counted = patterns.join(weights.unionByName(own), "site").groupBy("rep", "p").agg(F.sum("w").alias("w"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [dict(x.split(":") for x in p.split(",")) for p in rows["p"]]
        names = sorted({t for c in columns for t in c})
        masks = {t: np.array([1 << int(c[t]) if t in c else 15 for c in columns]) for t in names}
        data = L.Data.of(masks)
        data.weights = np.bincount(data.pattern_of_site, rows["w"].to_numpy(float), len(data.weights))
        tree, _ = L.ml_search(names, data, L.Model(), L.nni)
        return pd.DataFrame({"tree": [str(key[0])], "splits": [[",".join(sorted(x)) for x in split_sets(tree)]]})

    found = counted.groupBy("rep").applyInPandas(run, "tree string, splits array<string>").select("tree", F.explode("splits").alias("split"))
    best = found.where("tree = '0'").select("split")
    n = found.where("tree <> '0'").groupBy("split").agg(F.countDistinct("tree").alias("n"))
    return best.join(n, "split", "left").select("split", F.round(100.0 * F.coalesce("n", F.lit(0)) / F.lit(reps), 4).alias("support"))


add("ml_bootstrap", ml_bootstrap)


def continuous_search(s, d):
    """A tree of the labels' mean embeddings with the greatest Brownian likelihood: from the average-linkage tree by nearest-neighbour moves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="taxon", columns="char", values="value")
        values = {str(t): wide.loc[t].to_numpy() for t in wide.index}
        names = sorted(values)
        apart = np.array([[np.square(values[a] - values[b]).mean() for b in names] for a in names])
        tree = C.upgma(names, apart)
        for node in tree.postorder():
            node.length = max(node.length or 0.0, 1e-3)
        best = Y.brownian_lnl(tree, values)[0]
        while True:
            found = None
            for trial in L.nni(tree):
                if (own := Y.brownian_lnl(trial, values)[0]) > best + 1e-6:
                    best, found = own, trial.copy()
            if found is None:
                return pd.DataFrame({"lnl": [round(best, 4)], "newick": [write(tree)]})
            tree = found

    return E.traits(s, d).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "lnl double, newick string")


add("continuous_search", continuous_search)

QUARTETS = ("((A:1,B:1):1,C:1,D:1);", "((A:1,C:1):1,B:1,D:1);", "((A:1,D:1):1,B:1,C:1);")


def _zone_tree(long: float, short: float) -> Node:
    """Four taxa of which two that aren't neighbours have long branches."""
    return parse(f"((A:{long},B:{short}):{short},C:{long},D:{short});")


def felsenstein_zone(s, d, replicates: int = 20, sizes: tuple[int, ...] = (100, 500, 2000), long: float = 1.5, short: float = 0.05):
    """How often parsimony and likelihood find the true tree of four taxa, by number of sites: ``sites, replicates, parsimony_percent, likelihood_percent``.

    A cell of the experiment (number of sites, replicate) is a group; its seed is its number. Ties for the fewest steps go to the first tree.
    """
    cells = s.range(replicates).select(F.explode(F.array(*map(F.lit, sizes))).alias("sites"), F.col("id").alias("replicate"))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        n, replicate = int(key[0]), int(key[1])
        masks = L.simulate(_zone_tree(long, short), n, L.Model(), 1000 * replicate + n)
        data = L.Data.of(masks)
        trees = [parse(q) for q in QUARTETS]
        steps = [M.score(t, masks) for t in trees]
        for t in trees:
            for node in t.postorder():
                node.length = 0.2
        values = [L.optimize_lengths(t, data, L.Model(), rounds=4) for t in trees]
        return pd.DataFrame({"sites": [n], "replicate": [replicate], "parsimony": [int(np.argmin(steps))], "likelihood": [int(np.argmax(values))]})

    won = cells.repartition("sites", "replicate").groupBy("sites", "replicate").applyInPandas(run, "sites int, replicate long, parsimony int, likelihood int")
    percent = lambda c: F.round(100 * F.avg((F.col(c) == 0).cast("double")), 2)
    return won.groupBy("sites").agg(F.count("*").alias("replicates"), percent("parsimony").alias("parsimony_percent"), percent("likelihood").alias("likelihood_percent"))


add("felsenstein_zone", felsenstein_zone)


def random_tree(n_taxa: int, seed: int, height: float = 0.5) -> Node:
    """A random rooted tree with exponential lengths, scaled to a mean distance of ``height`` from the root to its tips."""
    rng = np.random.default_rng(seed)
    nodes = [Node(f"t{k}", float(rng.exponential())) for k in range(n_taxa)]
    while len(nodes) > 1:
        a, b = (nodes.pop(int(rng.integers(len(nodes)))) for _ in range(2))
        nodes.append(Node(length=float(rng.exponential()), children=[a, b]))
    root = nodes[0]
    depth = {root: 0.0}
    for node in root.preorder():
        for child in node.children:
            depth[child] = depth[node] + child.length
    mean = float(np.mean([depth[n] for n in root.leaves()]))
    for node in root.postorder():
        node.length = None if node is root else node.length * height / mean
    return root


def recovery(s, d, replicates: int = 8, sizes: tuple[int, ...] = (200, 1000), n_taxa: int = 10):
    """Sequences evolved down random trees, and how far neighbour joining is from them: ``sites, rf, exact_percent``."""
    cells = s.range(replicates).select(F.explode(F.array(*map(F.lit, sizes))).alias("sites"), F.col("id").alias("replicate"))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        n, seed = int(key[0]), int(key[1])
        true = random_tree(n_taxa, seed)
        masks = L.simulate(true, n, L.Model(), seed)
        names, data = sorted(masks), L.Data.of(masks)
        found, _d = _start(names, data)
        return pd.DataFrame({"sites": [n], "rf": [float(robinson_foulds(found, true))]})

    found = cells.repartition("sites", "replicate").groupBy("sites", "replicate").applyInPandas(run, "sites int, rf double")
    return found.groupBy("sites").agg(F.round(F.avg("rf"), 4).alias("rf"), F.round(100 * F.avg((F.col("rf") == 0).cast("double")), 2).alias("exact_percent"))


add("simulated_recovery", recovery)
