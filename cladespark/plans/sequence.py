"""Queries over alignments: distances, column aggregates, invariants, compatibility."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from .. import encode as E
from ..operators import distances as D
from ..operators.ml_distances import ml_distances
from ..operators import sitewise as S
from .book import add

PAIRS_SQL = f"""{E.SITES_SQL},
pairs AS (SELECT x.taxon AS i, y.taxon AS j, {", ".join(f"count(*) FILTER (x.state = {a} AND y.state = {b}) AS c{a}{b}" for a in range(4) for b in range(4))}, count(*)::DOUBLE AS n
  FROM sites x JOIN sites y ON x.site = y.site AND x.taxon < y.taxon GROUP BY ALL),
k AS (SELECT *, (c00 + c11 + c22 + c33) / n AS same, (c02 + c20 + c13 + c31) / n AS p, 1 - (c00 + c11 + c22 + c33 + c02 + c20 + c13 + c31) / n AS q,
  (2 * c00 + c01 + c02 + c03 + c10 + c20 + c30) / (2 * n) AS fa, (2 * c11 + c01 + c21 + c31 + c10 + c12 + c13) / (2 * n) AS fc,
  (2 * c22 + c02 + c12 + c32 + c20 + c21 + c23) / (2 * n) AS fg, (2 * c33 + c03 + c13 + c23 + c30 + c31 + c32) / (2 * n) AS ft FROM pairs),
f AS (SELECT *, fc * ft / (fc + ft) + fa * fg / (fa + fg) AS va, fc * ft + fa * fg AS vb, (fa + fg) * (fc + ft) AS vc, 1 - fa * fa - fc * fc - fg * fg - ft * ft AS vr FROM k)"""


def _ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def _distance_sql(d: str) -> str:
    return f"WITH {PAIRS_SQL}\nSELECT i, j, round({d}, 6) AS d FROM f"


def _determinant() -> str:
    terms = []
    for order in permutations(range(4)):
        odd = sum(order[a] > order[b] for a in range(4) for b in range(a + 1, 4)) % 2
        terms.append(("-" if odd else "+") + "*".join(f"(c{r}{c}/n)" for r, c in enumerate(order)))
    return "(" + "".join(terms) + ")"


def _margins() -> str:
    rows = ["+".join(f"c{a}{b}" for b in range(4)) for a in range(4)] + ["+".join(f"c{a}{b}" for a in range(4)) for b in range(4)]
    return "+".join(f"({_ln(f'(({r})/n)')})" for r in rows)


def _counts(spark, sf_dir):
    return D.pair_counts(E.sites(spark, sf_dir))


X = "(4 * same - 1) / 3"
for name, expression, sql in (
    ("jc69_distance", D.jc69, f"-0.75e0 * ({_ln(X)})"),
    ("jc69_gamma_distance", lambda: D.jc69(0.5), f"CASE WHEN {X} > 0 THEN 0.75e0 * 0.5e0 * (pow({X}, -2) - 1) END"),
    ("k2p_distance", D.k2p, f"-0.5e0 * ({_ln('(1 - 2 * p - q)')}) - 0.25e0 * ({_ln('(1 - 2 * q)')})"),
    ("k2p_gamma_distance", lambda: D.k2p(2.0), "CASE WHEN 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN (1 - 2 * p - q) ** -0.5e0 + 0.5e0 * (1 - 2 * q) ** -0.5e0 - 1.5e0 END"),
    ("f81_distance", D.f81, f"-vr * ({_ln('(1 - (1 - same) / vr)')})"),
    ("f84_distance", D.f84, f"-2 * va * ({_ln('(1 - p / (2 * va) - (va - vb) * q / (2 * va * vc))')}) + 2 * (va - vb - vc) * ({_ln('(1 - q / (2 * vc))')})"),
    ("f84_uncorrected_distance", D.f84_uncorrected, f"-2 * va * ({_ln('(1 - vc * p / (2 * va))')}) - 2 * (va - vb) * ({_ln('(1 - q / (2 * vc))')})"),
    ("logdet_distance", D.logdet, f"(-({_ln(_determinant())}) + 0.5e0 * ({_margins()})) / 4"),
):
    add(name, lambda spark, sf_dir, e=expression: D.distances(_counts(spark, sf_dir), e()), _distance_sql(sql))

FIXED = (0.3, 0.2, 0.15, 0.35)
_A, _C, _G, _T = (f"{p}e0" for p in FIXED)
_FIXED_SQL = f"""WITH {PAIRS_SQL}, g AS (SELECT *, {_C} * {_T} / ({_C} + {_T}) + {_A} * {_G} / ({_A} + {_G}) AS ga, {_C} * {_T} + {_A} * {_G} AS gb,
  ({_A} + {_G}) * ({_C} + {_T}) AS gc, 1 - {_A} * {_A} - {_C} * {_C} - {_G} * {_G} - {_T} * {_T} AS gr FROM f)
SELECT i, j, round({{}}, 6) AS d FROM g"""
add("f81_fixed_distance", lambda spark, sf_dir: D.distances(_counts(spark, sf_dir), D.f81(frequencies=FIXED)), _FIXED_SQL.format(f"-gr * ({_ln('(1 - (1 - same) / gr)')})"))
add(
    "f84_fixed_distance",
    lambda spark, sf_dir: D.distances(_counts(spark, sf_dir), D.f84(frequencies=FIXED)),
    _FIXED_SQL.format(f"-2 * ga * ({_ln('(1 - p / (2 * ga) - (ga - gb) * q / (2 * ga * gc))')}) + 2 * (ga - gb - gc) * ({_ln('(1 - q / (2 * gc))')})"),
)


def _rounded(found):
    return found.select("i", "j", F.round("d", 4).alias("d"))


add(
    "ml_jc69_distance",
    lambda spark, sf_dir: _rounded(ml_distances(_counts(spark, sf_dir))),
    f"WITH {PAIRS_SQL} SELECT i, j, round(CASE WHEN same = 1 THEN 0 WHEN {X} > 0 THEN least(10, -0.75e0 * ln({X})) ELSE 10 END, 4) AS d FROM f",
)
add("ml_f81_distance", lambda spark, sf_dir: _rounded(ml_distances(_counts(spark, sf_dir), "f81", FIXED)))
add("ml_f84_distance", lambda spark, sf_dir: _rounded(ml_distances(_counts(spark, sf_dir), "f84", ratio=2.0)))
add(
    "transition_ratio",
    lambda spark, sf_dir: D.transition_ratio(_counts(spark, sf_dir)),
    f"""WITH {PAIRS_SQL} SELECT sum(c02 + c20 + c13 + c31)::BIGINT AS ts, sum(n - c00 - c11 - c22 - c33 - c02 - c20 - c13 - c31)::BIGINT AS tv,
    round(greatest(0.5e0, least(20e0, sum(c02 + c20 + c13 + c31) / sum(n - c00 - c11 - c22 - c33 - c02 - c20 - c13 - c31))), 6) AS ratio FROM pairs""",
)

PROTEIN_SQL = f"""WITH {E.RESIDUES_SQL},
p AS (SELECT x.taxon AS i, y.taxon AS j, 1 - sum((x.state = y.state)::INTEGER) / count(*)::DOUBLE AS p FROM residues x JOIN residues y ON x.site = y.site AND x.taxon < y.taxon GROUP BY ALL)
SELECT i, j, round({{}}, 6) AS d FROM p"""
for method, sql in (("poisson", f"-({_ln('(1 - p)')})"), ("kimura", f"-({_ln('(1 - p - 0.2e0 * p * p)')})"), ("pam", f"-100 * ({_ln('(1 - p - 0.2e0 * p * p)')})")):
    add(f"protein_{method}", lambda spark, sf_dir, m=method: D.state_pairs(E.residues(spark, sf_dir)).select("i", "j", F.round(D.protein(m), 6).alias("d")), PROTEIN_SQL.format(sql))

RESTRICTION_D = "-0.75e0 * ln(1 - 4 * (1 - pow(s, 1 / 6e0)) / 3)"
add(
    "restriction_nei_li",
    lambda spark, sf_dir: D.restriction(E.characters(spark, sf_dir)),
    f"""WITH {E.CHARACTERS_SQL}, p AS (SELECT x.taxon AS i, y.taxon AS j, 2 * sum(x.state * y.state) / nullif(sum(x.state + y.state), 0)::DOUBLE AS s
    FROM chars x JOIN chars y ON x.char = y.char AND x.taxon < y.taxon GROUP BY ALL)
    SELECT i, j, CASE WHEN 1 - 4 * (1 - pow(s, 1 / 6e0)) / 3 > 0 THEN round({RESTRICTION_D}, 6) END AS d FROM p""",
)

FREQUENCY_SQL = f"""WITH {E.FREQUENCIES_SQL}, own AS (SELECT pop, sum(f * f) AS ff, count(DISTINCT locus)::DOUBLE AS loci FROM freqs GROUP BY pop),
s AS (SELECT x.pop AS i, y.pop AS j, sum(x.f * y.f) AS xy, sum(sqrt(x.f * y.f)) AS root FROM freqs x JOIN freqs y ON x.locus = y.locus AND x.allele = y.allele AND x.pop < y.pop GROUP BY ALL),
z AS (SELECT i, j, xy, root, a.ff AS xx, b.ff AS yy, a.loci FROM s JOIN own a ON i = a.pop JOIN own b ON j = b.pop) SELECT i, j, round({{}}, 6) AS d FROM z"""
for method, sql in (
    ("nei", "-ln(xy / sqrt(xx * yy))"),
    ("chord", "sqrt(greatest(0, 2 / loci * (loci - root)))"),
    ("reynolds", "CASE WHEN 1 - (xx + yy - 2 * xy) / (2 * (loci - xy)) > 0 THEN -ln(1 - (xx + yy - 2 * xy) / (2 * (loci - xy))) END"),
):
    add(f"frequency_{method}", lambda spark, sf_dir, m=method: D.gene_frequency_distances(E.frequencies(spark, sf_dir), m), FREQUENCY_SQL.format(sql))

add(
    "base_frequencies",
    lambda spark, sf_dir: S.base_frequencies(E.sites(spark, sf_dir)),
    f"WITH {E.SITES_SQL} SELECT taxon, {', '.join(f'round(avg((state = {k})::INTEGER), 6) AS f{b}' for k, b in enumerate('acgt'))} FROM sites GROUP BY taxon",
)
add(
    "site_patterns",
    lambda spark, sf_dir: S.site_patterns(E.sites(spark, sf_dir)),
    f"WITH {E.SITES_SQL} SELECT pattern, count(*) AS n FROM (SELECT site, string_agg(taxon || ':' || state, ',' ORDER BY taxon) AS pattern FROM sites GROUP BY site) GROUP BY pattern",
)
add(
    "site_summary",
    lambda spark, sf_dir: S.site_summary(E.sites(spark, sf_dir)),
    f"""WITH {E.SITES_SQL} SELECT site, sum(n)::BIGINT AS n_taxa, count(*) AS n_states, count(*) - 1 AS steps, count(*) = 1 AS constant, count(*) FILTER (n > 1) > 1 AS informative
    FROM (SELECT site, state, count(*) AS n FROM sites GROUP BY ALL) GROUP BY site""",
)
add(
    "majority_characters",
    lambda spark, sf_dir: S.majority_characters(E.sites(spark, sf_dir)),
    f"""WITH {E.SITES_SQL}, top AS (SELECT site, arg_max(state, n * 10 - state) AS major FROM (SELECT site, state, count(*) AS n FROM sites GROUP BY ALL) GROUP BY site)
    SELECT taxon, site AS char, (state <> major)::INTEGER AS state FROM sites JOIN top USING (site)""",
)

REGION_SITES_SQL = f"""{E.SALES_SQL}, regions AS (SELECT DISTINCT region AS taxon, site, ((site + CASE WHEN rq % 4 = 0 THEN 1 + (rq // 4) % 3 ELSE 0 END) % 4)::INTEGER AS state FROM sales)"""
REGIONS_SQL = f"""{REGION_SITES_SQL},
quartets AS (SELECT a.taxon AS t1, b.taxon AS t2, c.taxon AS t3, d.taxon AS t4, a.state AS s1, b.state AS s2, c.state AS s3, d.state AS s4 FROM regions a
      JOIN regions b ON a.site = b.site AND a.taxon < b.taxon
  JOIN regions c ON b.site = c.site AND b.taxon < c.taxon JOIN regions d ON c.site = d.site AND c.taxon < d.taxon)"""


def region_sites(spark, sf_dir):
    """One sequence per region: states before the changes in nations."""
    sold = E.sales(spark, sf_dir).withColumn("taxon", F.col("region")).withColumn("q", F.lit(1))
    return E._states(sold, 4).select("taxon", "site", "state").distinct()


add(
    "quartet_patterns",
    lambda spark, sf_dir: S.quartet_patterns(region_sites(spark, sf_dir)),
    f"WITH {REGIONS_SQL} SELECT t1, t2, t3, t4, (((s1 * 4 + s2) * 4 + s3) * 4 + s4)::INTEGER AS pattern, count(*) AS n FROM quartets GROUP BY ALL",
)
add(
    "lake_support",
    lambda spark, sf_dir: S.lake_support(region_sites(spark, sf_dir)),
    f"""WITH {REGIONS_SQL}, n AS (SELECT t1, t2, t3, t4, count(*) FILTER (s1 = s2 AND s3 = s4 AND s1 % 2 <> s3 % 2) AS n1, count(*) FILTER (s1 = s3 AND s2 = s4 AND s1 % 2 <> s2 % 2) AS n2,
    count(*) FILTER (s1 = s4 AND s2 = s3 AND s1 % 2 <> s2 % 2) AS n3 FROM quartets GROUP BY ALL)
    SELECT *, (CASE WHEN n1 >= n2 AND n1 >= n3 THEN 1 WHEN n2 >= n3 THEN 2 ELSE 3 END)::INTEGER AS best,
    CASE WHEN n1 + n2 + n3 > 0 THEN round(3e0 * (n1 * n1 + n2 * n2 + n3 * n3) / (n1 + n2 + n3) - (n1 + n2 + n3), 6) END AS chi_square FROM n""",
)
add(
    "cavender",
    lambda spark, sf_dir: S.cavender(region_sites(spark, sf_dir)),
    f"""WITH {REGIONS_SQL}, y AS (SELECT t1, t2, t3, t4, s1 % 2 AS s1, s2 % 2 AS s2, s3 % 2 AS s3, s4 % 2 AS s4 FROM quartets),
    n AS (SELECT t1, t2, t3, t4, count(*) FILTER (s1 = s2 AND s3 = s4 AND s1 <> s3) AS n1, count(*) FILTER (s1 = s3 AND s2 = s4 AND s1 <> s2) AS n2, count(*) FILTER (s1 = s4 AND s2 = s3 AND s1 <> s2) AS n3 FROM y GROUP BY ALL),
    d AS (SELECT *, n2 - n3 AS d1, n1 - n3 AS d2, n1 - n2 AS d3 FROM n)
    SELECT *, (CASE WHEN abs(d1) <= abs(d2) AND abs(d1) <= abs(d3) THEN 1 WHEN abs(d2) <= abs(d3) THEN 2 ELSE 3 END)::INTEGER AS best FROM d""",
)
COMPATIBLE_SQL = f"""{E.CHARACTERS_SQL}, pairs AS (SELECT x.char AS a, y.char AS b, count(DISTINCT 2 * x.state + y.state) AS n_gametes FROM chars x JOIN chars y ON x.taxon = y.taxon AND x.char < y.char GROUP BY ALL)"""
add("compatible_pairs", lambda spark, sf_dir: S.compatible_pairs(E.characters(spark, sf_dir)), f"WITH {COMPATIBLE_SQL} SELECT *, n_gametes <= 3 AS compatible FROM pairs")
add(
    "compatible_degree",
    lambda spark, sf_dir: S.compatible_degree(E.characters(spark, sf_dir)),
    f"WITH {COMPATIBLE_SQL} SELECT char, count(*) FILTER (n_gametes <= 3) AS degree FROM (SELECT a AS char, n_gametes FROM pairs UNION ALL SELECT b, n_gametes FROM pairs) GROUP BY char",
)
add(
    "nj_first_join",
    lambda spark, sf_dir: S.first_join(D.gene_frequency_distances(E.frequencies(spark, sf_dir))),
    f"""WITH dist AS ({FREQUENCY_SQL.format("-ln(xy / sqrt(xx * yy))")}), both_ways AS (SELECT i, d FROM dist UNION ALL SELECT j, d FROM dist), r AS (SELECT i, sum(d) AS r FROM both_ways GROUP BY i)
    SELECT dist.i, dist.j, round(((SELECT count(*) FROM r) - 2) * d - a.r - b.r, 4) AS q FROM dist JOIN r a ON dist.i = a.i JOIN r b ON dist.j = b.i ORDER BY q, 1, 2 LIMIT 1""",
)
