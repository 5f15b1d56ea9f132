"""Comparisons of methods, each a claim that can be run: on the tables where SQL can say it, else on simulated sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import encode as E
from ..functions import clustering as C
from ..functions import comparative as Y
from ..functions import likelihood as L
from ..functions.newick import Node, split_sets
from ..operators import distances as D
from ..operators import folds as T
from ..operators import sitewise as S
from ..operators.genetic_code import CODE, codons
from .book import add
from .kernels import _matrix
from .searches import random_tree
from .sequence import FREQUENCY_SQL, REGIONS_SQL, region_sites
from .trees import BINARY_SQL, _binary

# Published polar requirements of amino acids, in the order of POLAR_ORDER.
POLAR_ORDER = "ACDEFGHIKLMNPQRSTVWY"
POLAR = (7.0, 4.8, 13.0, 12.5, 5.0, 7.9, 8.4, 4.9, 10.1, 4.9, 5.3, 10.0, 6.6, 8.6, 9.1, 7.5, 6.6, 5.6, 5.2, 5.4)


def tree_space(s, d) -> DataFrame:
    """How many unrooted binary trees taxa have, for each number of nations from 3 on: ``taxa, log10_trees``."""
    n = E.table(s, d, "nation").agg(F.count("*").cast("int").alias("n")).select(F.explode(F.sequence(F.lit(3), F.col("n"))).alias("taxa"))
    logs = F.transform(F.sequence(F.lit(3), F.col("taxa")), lambda k: F.log10((2 * k - 5).cast("double")))
    return n.select("taxa", F.round(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x), 6).alias("log10_trees"))


add("tree_space", tree_space, "SELECT taxa::INTEGER AS taxa, round((SELECT sum(log10((2 * k - 5)::DOUBLE)) FROM generate_series(3, taxa) g(k)), 6) AS log10_trees FROM (SELECT unnest(generate_series(3, (SELECT count(*) FROM nation))) AS taxa)")


def dollo_and_fitch(s, d) -> DataFrame:
    """Steps of each binary site on the nations' tree if states change freely, and if each is gained once: ``site, fitch, dollo``."""
    binary = _binary(s, d)
    free = T.fitch(E.tree(s, d), binary.select("node", "site", (F.col("state") + 1).alias("mask")), root_only=True)
    once = T.dollo(E.tree(s, d), binary).select("site", (F.col("gains") + F.col("losses")).alias("dollo"))
    return free.select("site", F.col("steps").alias("fitch")).join(once, "site")


add(
    "dollo_and_fitch",
    dollo_and_fitch,
    f"""WITH {BINARY_SQL}, low AS (SELECT region + 100 AS node, site, list_reduce(list((1 + state)::BIGINT ORDER BY taxon), lambda a, x: CASE WHEN (a & 3 & x) > 0 THEN a - (a & 3) + (a & 3 & x) ELSE a - (a & 3) + 4 + ((a & 3) | x) END) AS c FROM b GROUP BY ALL),
    top AS (SELECT site, list_reduce(list((c & 3)::BIGINT ORDER BY node), lambda a, x: CASE WHEN (a & 3 & x) > 0 THEN a - (a & 3) + (a & 3 & x) ELSE a - (a & 3) + 4 + ((a & 3) | x) END) AS c, sum(c >> 2) AS below FROM low GROUP BY site),
    r AS (SELECT region, site, sum(state) AS ones, count(*) FILTER (state = 0) AS zeros FROM b GROUP BY ALL),
      t AS (SELECT site, sum(ones) AS total, count(*) FILTER (ones > 0) AS with_ones, count(*) FILTER (ones = 0) AS without,
    sum(CASE WHEN ones > 0 THEN zeros ELSE 0 END) AS inner_losses FROM r GROUP BY site)
    SELECT top.site, ((c >> 2) + below)::BIGINT AS fitch, (CASE WHEN total > 0 THEN 1 ELSE 0 END + CASE WHEN total <= 1 THEN 0 WHEN with_ones = 1 THEN inner_losses ELSE inner_losses + without END)::BIGINT AS dollo FROM top JOIN t ON top.site = t.site""",
)


def chord_angles(s, d) -> DataFrame:
    """The chord between populations on the unit sphere of roots of frequencies, and its angle in degrees: ``i, j, chord, angle``."""
    chord = D.gene_frequency_distances(E.frequencies(s, d), "chord").withColumnRenamed("d", "chord")
    return chord.select("i", "j", "chord", F.round(F.degrees(2 * F.asin(F.least(F.col("chord") / 2, F.lit(1.0)))), 3).alias("angle"))


add("chord_angles", chord_angles, f"SELECT i, j, d AS chord, round(degrees(2 * asin(least(d / 2, 1e0))), 3) AS angle FROM ({FREQUENCY_SQL.format('sqrt(greatest(0, 2 / loci * (loci - root)))')})")

EIGHTHS = (1, 2, 4, 8)


def lake_by_sites(s, d) -> DataFrame:
    """Transversion support of each quartet of regions from more and more sites, up to all: ``sites, t1 .. t4, best, chi_square``."""
    out, every = None, E.table(s, d, "part").count()
    for k in EIGHTHS:
        n = every * k // 8
        own = S.lake_support(region_sites(s, d).where(F.col("site") < n)).select(F.lit(n).cast("long").alias("sites"), "t1", "t2", "t3", "t4", "best", "chi_square")
        out = own if out is None else out.unionByName(own)
    return out


add(
    "lake_by_sites",
    lake_by_sites,
    f"""WITH {REGIONS_SQL.replace("d.state AS s4 FROM", "d.state AS s4, a.site AS site FROM")},
      n AS (SELECT k::BIGINT AS sites, t1, t2, t3, t4, count(*) FILTER (s1 = s2 AND s3 = s4 AND s1 % 2 <> s3 % 2) AS n1,
    count(*) FILTER (s1 = s3 AND s2 = s4 AND s1 % 2 <> s2 % 2) AS n2, count(*) FILTER (s1 = s4 AND s2 = s3 AND s1 % 2 <> s2 % 2) AS n3 FROM quartets JOIN (SELECT (SELECT count(*)
      FROM part) * unnest({list(EIGHTHS)}) // 8 AS k) ON site < k GROUP BY ALL)
    SELECT sites, t1, t2, t3, t4, (CASE WHEN n1 >= n2 AND n1 >= n3 THEN 1 WHEN n2 >= n3 THEN 2 ELSE 3 END)::INTEGER AS best,
    CASE WHEN n1 + n2 + n3 > 0 THEN round(3e0 * (n1 * n1 + n2 * n2 + n3 * n3) / (n1 + n2 + n3) - (n1 + n2 + n3), 6) END AS chi_square FROM n""",
)


def code_permutations(s, d, permutations: int = 200) -> DataFrame:
    """Mean squared change of polar requirement by a base change between codons of different amino acids, and how far the standard code lies from codes whose
    amino acids are permuted: ``real, mean, sd, z, better``. Permutation 0 is the standard code; the others order the amino acids by a hash."""
    amino = s.range(20).select(F.substr(F.lit(POLAR_ORDER), (F.col("id") + 1).cast("int"), F.lit(1)).alias("aa"), F.col("id").alias("k"))
    polar = s.range(20).select(F.col("id").alias("to"), F.element_at(F.array(*map(F.lit, POLAR)), (F.col("id") + 1).cast("int")).alias("p"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.when(F.col("rep") == 0, F.lpad(F.col("k").cast("string"), 2, "0")).otherwise(F.md5(F.concat_ws(":", F.lit("code"), F.col("rep").cast("string"), "aa"))))) - 1
    values = amino.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations)))).select("rep", "aa", rank.cast("long").alias("to")).join(F.broadcast(polar), "to").select("rep", "aa", "p")
    c = codons(s)
    x, y = (c.select(F.col("aa").alias(n), *(F.col(f"b{k}").alias(f"{n}{k}") for k in range(3))) for n in "xy")
    apart = sum(((F.col(f"x{k}") != F.col(f"y{k}")).cast("int") for k in range(3)), F.lit(0))
    steps = x.join(F.broadcast(y), apart == 1).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("n"))
    own = steps.join(values.withColumnsRenamed({"aa": "x", "p": "px"}), "x").join(values.withColumnsRenamed({"aa": "y", "p": "py"}), ["rep", "y"])
    square = F.col("n") * (F.col("px") - F.col("py")) * (F.col("px") - F.col("py"))
    means = own.groupBy("rep").agg(F.round(F.sum(square) / F.sum("n"), 9).alias("m"))
    real = means.where("rep = 0").select(F.col("m").alias("real"))
    other = means.where("rep > 0").join(F.broadcast(real))
    found = other.groupBy("real").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count_if(F.col("m") <= F.col("real")).alias("better"))
    return found.select(F.round("real", 6).alias("real"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round((F.col("real") - F.col("mean")) / F.col("sd"), 4).alias("z"), "better")


_CODON_SQL = f"SELECT substr('{CODE}', k::INTEGER + 1, 1) AS aa, k // 16 AS b0, k // 4 % 4 AS b1, k % 4 AS b2 FROM (SELECT unnest(generate_series(0, 63)) AS k)"
add(
    "code_permutations",
    code_permutations,
    f"""WITH amino AS (SELECT substr('{POLAR_ORDER}', k::INTEGER + 1, 1) AS aa, k FROM (SELECT unnest(generate_series(0, 19)) AS k)), reps AS (SELECT unnest(generate_series(0, 200)) AS rep),
    ranked AS (SELECT rep, aa, row_number() OVER (PARTITION BY rep ORDER BY CASE WHEN rep = 0 THEN lpad(k::VARCHAR, 2, '0') ELSE md5('code:' || rep || ':' || aa) END) AS r FROM amino, reps),
    v AS (SELECT rep, aa, ([{", ".join(f"{p}e0" for p in POLAR)}])[r] AS p FROM ranked), codon AS ({_CODON_SQL}),
    steps AS (SELECT x.aa AS x, y.aa AS y, count(*) AS n FROM codon x, codon y
      WHERE x.aa <> '*' AND y.aa <> '*' AND x.aa <> y.aa AND (x.b0 <> y.b0)::INTEGER + (x.b1 <> y.b1)::INTEGER + (x.b2 <> y.b2)::INTEGER = 1 GROUP BY ALL),
    m AS (SELECT a.rep, round(sum(n * (a.p - b.p) * (a.p - b.p)) / sum(n), 9) AS m FROM steps JOIN v a ON a.aa = x JOIN v b ON b.aa = y AND a.rep = b.rep GROUP BY a.rep),
      r AS (SELECT m AS real FROM m WHERE rep = 0)
    SELECT round(real, 6) AS real, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round((real - avg(m)) / stddev_samp(m), 4) AS z, count(*) FILTER (m <= real) AS better
      FROM m, r WHERE rep > 0 GROUP BY real""",
)


def least_squares_scores(s, d) -> DataFrame:
    """Weighted squares that trees of one matrix leave, with and without a clock: ``method, score``. The free tree fits best, and fitted heights no worse than average linkage."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names, m = C.matrix(rows)
        clock, free = C.upgma(names, m), C.fitch_margoliash(names, m)[1]
        return pd.DataFrame({"method": ["fm", "kitsch", "upgma"], "score": np.round([free, C.kitsch(names, m)[1], C.weighted_squares(clock, names, m)], 6)})

    return _matrix(s, d).groupBy("aln").applyInPandas(run, "method string, score double")


add("least_squares_scores", least_squares_scores)


def _biased(n: int, seed: int) -> dict[str, np.ndarray]:
    """Four sequences whose first and third lineages, which aren't neighbours, have become rich in G and C."""
    rng = np.random.default_rng(seed)
    rich, poor = L.Model((0.1, 0.4, 0.4, 0.1)), L.Model((0.4, 0.1, 0.1, 0.4))

    def moved(state: np.ndarray, model: L.Model, t: float) -> np.ndarray:
        table = model.transition(t).cumsum(1)
        return np.minimum((rng.random(n)[:, None] > table[state]).sum(1), 3)

    left = rng.choice(4, n)
    right = moved(left, L.Model(), 0.1)
    return {"A": moved(left, rich, 0.6), "B": moved(left, poor, 0.6), "C": moved(right, rich, 0.6), "D": moved(right, poor, 0.6)}


def composition_bias(s, d, replicates: int = 20, sizes: tuple[int, ...] = (500, 5000)) -> DataFrame:
    """How often neighbour joining finds the true pairs of taxa when two other taxa share their composition: ``sites, jc69_percent, logdet_percent``."""
    cells = s.range(replicates).select(F.explode(F.array(*map(F.lit, sizes))).alias("sites"), F.col("id").alias("replicate"))

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        n, seed = int(key[0]), int(key[1])
        states = _biased(n, seed)
        names = sorted(states)
        jc, ld = np.zeros((4, 4)), np.zeros((4, 4))
        for i in range(4):
            for j in range(i):
                f = np.zeros((4, 4))
                np.add.at(f, (states[names[i]], states[names[j]]), 1 / n)
                jc[i, j] = jc[j, i] = -0.75 * np.log(max(1e-9, 1 - 4 * (1 - np.trace(f)) / 3))
                scale = np.log(max(f.sum(0).prod() * f.sum(1).prod(), 1e-300)) / 2
                ld[i, j] = ld[j, i] = (scale - np.log(max(np.linalg.det(f), 1e-300))) / 4
        true = {frozenset("CD")}
        return pd.DataFrame({"sites": [n], "jc69": [set(split_sets(C.neighbor_joining(names, jc))) == true], "logdet": [set(split_sets(C.neighbor_joining(names, ld))) == true]})

    won = cells.repartition("sites", "replicate").groupBy("sites", "replicate").applyInPandas(run, "sites int, jc69 boolean, logdet boolean")
    percent = lambda c: F.round(100 * F.avg(F.col(c).cast("double")), 2).alias(f"{c}_percent")
    return won.groupBy("sites").agg(percent("jc69"), percent("logdet"))


add("composition_bias", composition_bias)


def resistance(root: Node) -> float:
    """Resistance between a tree's root and its tips tied together, branches being resistors of their length, by Kirchhoff's laws."""
    nodes = {n: k for k, n in enumerate(root.preorder())}
    parents = root.parents()
    inner = [n for n in nodes if not n.is_leaf]
    at = {n: k for k, n in enumerate(inner)}
    g = np.zeros((len(inner), len(inner)))
    for child, parent in parents.items():
        flow = 1 / child.length
        g[at[parent], at[parent]] += flow
        if child in at:
            g[at[child], at[child]] += flow
            g[at[child], at[parent]] -= flow
            g[at[parent], at[child]] -= flow
    push = np.zeros(len(inner))
    push[at[root]] = 1.0
    return float(np.linalg.solve(g, push)[at[root]])


def contrast_network(s, d, trees: int = 10, n_taxa: int = 16) -> DataFrame:
    """The variance that contrasts leave at the root of random trees, and the resistance of the same tree as a network: ``tree, variance, resistance``."""

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        root = random_tree(n_taxa, int(key[0]))
        extra: dict[Node, float] = {}
        for node in root.postorder():
            sides = [c.length + extra[c] for c in node.children]
            extra[node] = 1 / sum(1 / v for v in sides) if sides else 0.0
        _, variances = Y.contrasts(root, {n.name: np.zeros(1) for n in root.leaves()})
        a, b = (c.length + extra[c] for c in root.children)
        assert abs(variances[-1] - (a + b)) < 1e-9
        return pd.DataFrame({"tree": [int(key[0])], "variance": [round(extra[root], 8)], "resistance": [round(resistance(root), 8)]})

    return s.range(trees).groupBy("id").applyInPandas(run, "tree long, variance double, resistance double")


add("contrast_network", contrast_network)