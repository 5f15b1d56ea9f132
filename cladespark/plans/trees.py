"""Queries over trees: splits, folds, windows, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import encode as E
from ..functions.stats import gamma_rates
from ..operators import folds as T
from ..operators import resampling as R
from ..operators import splits as P
from ..operators.genetic_code import AMINO, steps, steps_sql
from .book import add
from .sequence import REGION_SITES_SQL, region_sites

TAXA = 25
GAMMA_RATES = tuple(round(float(r), 4) for r in gamma_rates(0.5, 4))


def _splits(spark, sf_dir, **by):
    return P.canonical(P.clade_masks(E.clades(spark, sf_dir, **by)), TAXA)


SPLITS_SQL = E.splits_sql("splits")
SUPPORT_SQL = f"{SPLITS_SQL}, support AS (SELECT split, count(*) AS n, round(count(*) / (SELECT count(DISTINCT tree) FROM splits)::DOUBLE, 6) AS support, round(avg(bl), 6) AS bl FROM splits GROUP BY split)"
PAIRS_SQL = f"""{SPLITS_SQL}, t AS (SELECT DISTINCT tree FROM splits), p AS (SELECT a.tree AS t1, b.tree AS t2 FROM t a, t b WHERE a.tree < b.tree),
u AS (SELECT t1, t2, split, sum(l1) AS l1, sum(l2) AS l2, count(*) AS k FROM (SELECT t1, t2, split, bl AS l1, 0e0 AS l2 FROM p JOIN splits ON tree = t1
      UNION ALL SELECT t1, t2, split, 0e0, bl FROM p JOIN splits ON tree = t2) GROUP BY ALL)"""
add("splits", lambda s, d: _splits(s, d).select("tree", "split", F.round("bl", 6).alias("bl")), f"WITH {SPLITS_SQL} SELECT tree, split, round(bl, 6) AS bl FROM splits")
add(
    "tree_distances",
    lambda s, d: P.tree_distances(_splits(s, d), TAXA),
    f"WITH {PAIRS_SQL} SELECT t1, t2, count(*) FILTER (k = 1) AS rf, round(count(*) FILTER (k = 1) / {2 * (TAXA - 3)}e0, 6) AS nrf, round(sqrt(sum((l1 - l2) * (l1 - l2))), 6) AS bsd FROM u GROUP BY ALL",
)
add("split_support", lambda s, d: P.split_support(_splits(s, d)), f"WITH {SUPPORT_SQL} SELECT * FROM support")
for method, rule in (("strict", "support >= 1"), ("majority", "support > 0.5"), ("threshold", "support >= 0.2")):
    add(f"consensus_{method}", lambda s, d, m=method: P.consensus(_splits(s, d), m, 0.2), f"WITH {SUPPORT_SQL} SELECT * FROM support WHERE {rule}")
EXTENDED_SQL = f"""{SUPPORT_SQL}, o AS (SELECT split, n, support, bl, row_number() OVER (ORDER BY n DESC, bit_count(split), split) AS k FROM support),
    x AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken
      UNION ALL SELECT o.k, CASE WHEN len(list_filter(x.taken, lambda t: t & o.split > 0 AND t & ~o.split > 0 AND o.split & ~t > 0 AND ({(1 << TAXA) - 1} & ~(t | o.split)) > 0)) = 0 THEN list_append(x.taken, o.split) ELSE x.taken END
      FROM x JOIN o ON o.k = x.k + 1),
    accepted AS (SELECT o.split, n, support, bl FROM o WHERE o.split IN (SELECT unnest(taken) FROM x WHERE k = (SELECT max(k) FROM x)))"""


def _extended(s, d):
    return P.consensus(_splits(s, d), "extended", n_taxa=TAXA)


add("consensus_extended", _extended, f"WITH RECURSIVE {EXTENDED_SQL} SELECT * FROM accepted")
add(
    "consensus_tree",
    lambda s, d: P.consensus_tree(_extended(s, d), TAXA),
    f"""WITH RECURSIVE {EXTENDED_SQL}, nodes AS (SELECT (1::BIGINT << k) AS node, NULL::DOUBLE AS support, NULL::DOUBLE AS bl
      FROM (SELECT unnest(generate_series(0, {TAXA - 1}))::INTEGER AS k) UNION ALL SELECT split, support, bl FROM accepted),
    above AS (SELECT split AS a FROM accepted UNION ALL SELECT {(1 << TAXA) - 1})
    SELECT node, arg_min(a, bit_count(a) * {1 << (TAXA + 1)} + a) AS parent, bit_count(node)::INTEGER AS taxa, any_value(support) AS support, any_value(bl) AS bl FROM nodes
      JOIN above ON a <> node AND a & node = node GROUP BY node
    UNION ALL SELECT {(1 << TAXA) - 1}, NULL, {TAXA}, NULL, NULL""",
)
add(
    "bootstrap_support",
    lambda s, d: P.reference_support(_splits(s, d, by="'all'"), _splits(s, d)),
    f"""WITH {SPLITS_SQL}, {E.splits_sql("ref", "'all'")} SELECT ref.split, round(100 * count(DISTINCT splits.tree) / (SELECT count(DISTINCT tree) FROM splits)::DOUBLE, 6) AS support
    FROM ref LEFT JOIN splits ON ref.split = splits.split GROUP BY ref.split""",
)


def _leaves(s, d):
    return E.sites(s, d).select(F.col("taxon").alias("node"), "site", "state")


def _masks(s, d):
    return _leaves(s, d).select("node", "site", F.pow(F.lit(2.0), F.col("state")).cast("int").alias("mask"))


FITCH_SQL = f"""{E.SITES_SQL},
low AS (SELECT region + 100 AS node, site, list_reduce(list((1 << state)::BIGINT ORDER BY taxon), lambda a, x: CASE WHEN (a & 15 & x) > 0 THEN a - (a & 15) + (a & 15 & x) ELSE a - (a & 15) + 16 + ((a & 15) | x) END) AS c FROM sites GROUP BY ALL),
top AS (SELECT site, list_reduce(list((c & 15)::BIGINT ORDER BY node), lambda a, x: CASE WHEN (a & 15 & x) > 0 THEN a - (a & 15) + (a & 15 & x) ELSE a - (a & 15) + 16 + ((a & 15) | x) END) AS c, sum(c >> 4) AS below FROM low GROUP BY site)"""
add(
    "fitch_steps",
    lambda s, d: T.fitch(E.tree(s, d), _masks(s, d), root_only=True).select("site", "mask", "steps"),
    f"WITH {FITCH_SQL} SELECT site, (c & 15)::INTEGER AS mask, ((c >> 4) + below)::BIGINT AS steps FROM top",
)
add(
    "fitch_ancestors",
    lambda s, d: T.fitch_ancestors(E.tree(s, d), T.fitch(E.tree(s, d), _masks(s, d))),
    f"""WITH {FITCH_SQL}, r AS (SELECT site, (c & 15)::INTEGER AS f FROM top), m AS (SELECT node, low.site, CASE WHEN (c & 15 & f) > 0 THEN c & 15 & f ELSE c & 15 END::INTEGER AS f
      FROM low JOIN r ON low.site = r.site),
    l AS (SELECT taxon, sites.site, CASE WHEN ((1 << state) & f) > 0 THEN (1 << state) & f ELSE 1 << state END::INTEGER AS f FROM sites JOIN m ON m.site = sites.site AND m.node = region + 100)
    SELECT -1 AS node, site, f AS final FROM r UNION ALL SELECT node, site, f FROM m UNION ALL SELECT taxon, site, f FROM l""",
)


def _forest(s, d):
    return T.with_levels(E.forest(s, d))


FOREST_HEIGHT = 5  # in SQL: of trees of 17 to 32 nations


def _forest_fitch_sql() -> str:
    merge = "lambda a, x: CASE WHEN (a & 15 & x) > 0 THEN a - (a & 15) + (a & 15 & x) ELSE a - (a & 15) + 16 + ((a & 15) | x) END"
    out = [f"WITH {E.SITES_SQL}, {E.SLOTS_SQL}, f0 AS (SELECT tree, site, slot AS i, (1 << state)::BIGINT AS m, 0 AS steps FROM slots JOIN sites USING (taxon))"]
    for k in range(1, FOREST_HEIGHT + 1):
        both = f"SELECT tree, site, i // 2 AS i, list_reduce(list(m ORDER BY i), {merge}) AS c, sum(steps) AS below FROM f{k - 1} GROUP BY tree, site, i // 2"
        out.append(f"f{k} AS (SELECT tree, site, i, c & 15 AS m, (c >> 4) + below AS steps FROM ({both}))")
    return ",\n".join(out) + f"\nSELECT tree, sum(steps)::BIGINT AS steps, count(*) AS sites FROM f{FOREST_HEIGHT} GROUP BY tree"


def _forest_lnl_sql() -> str:
    start = "l0 AS (SELECT tree, site, slot AS i, x, (state = x)::INTEGER::DOUBLE AS l FROM slots JOIN sites USING (taxon), (SELECT unnest([0, 1, 2, 3]) AS x))"
    out = [f"WITH {E.SITES_SQL}, {E.SLOTS_SQL}, {start}"]
    for k in range(1, FOREST_HEIGHT + 1):
        e = f"exp(-4e0 / 3 * 0.01e0 * {1 << (k - 1)})"
        below = f"SELECT *, sum(l) OVER (PARTITION BY tree, site, i) AS total FROM l{k - 1}"
        out.append(f"l{k} AS (SELECT tree, site, i // 2 AS i, x, product(0.25e0 * (1 - {e}) * total + {e} * l) AS l FROM ({below}) GROUP BY tree, site, i // 2, x)")
    sites = f"SELECT tree, site, round(ln(sum(0.25e0 * l)), 6) AS lnl FROM l{FOREST_HEIGHT} GROUP BY tree, site"
    return ",\n".join(out) + f"\nSELECT tree, round(sum(lnl), 3) AS lnl, count(*) AS sites FROM ({sites}) GROUP BY tree"


def _forest_lnl(s, d):
    return T.site_likelihoods(_forest(s, d), _leaves(s, d)).groupBy("tree").agg(F.round(F.sum("lnl"), 3).alias("lnl"), F.count("*").alias("sites"))


add("forest_fitch", lambda s, d: T.fitch_scores(_forest(s, d), _masks(s, d)), _forest_fitch_sql())
add("forest_lnl", _forest_lnl, _forest_lnl_sql())


def _binary(s, d):
    return E.sites(s, d).select(F.col("taxon").alias("node"), "site", (F.col("state") != F.col("site") % 4).cast("int").alias("state"))


BINARY_SQL = f"{E.SITES_SQL}, b AS (SELECT taxon, region, site, (state <> site % 4)::INTEGER AS state FROM sites)"
add(
    "camin_sokal",
    lambda s, d: T.camin_sokal(E.tree(s, d), _binary(s, d), root_only=True).select("site", "state", "steps"),
    f"""WITH {BINARY_SQL}, r AS (SELECT region, site, min(state) AS state, CASE WHEN min(state) = 1 THEN 0 ELSE sum(state) END AS steps FROM b GROUP BY ALL)
    SELECT site, min(state) AS state, (sum(steps) + CASE WHEN min(state) = 1 THEN 0 ELSE sum(state) END)::BIGINT AS steps FROM r GROUP BY site""",
)
add(
    "dollo",
    lambda s, d: T.dollo(E.tree(s, d), _binary(s, d)),
    f"""WITH {BINARY_SQL}, r AS (SELECT region, site, sum(state) AS ones, count(*) FILTER (state = 0) AS zeros FROM b GROUP BY ALL),
      t AS (SELECT site, sum(ones) AS total, count(*) FILTER (ones > 0) AS with_ones, count(*) FILTER (ones = 0) AS without,
    sum(CASE WHEN ones > 0 THEN zeros ELSE 0 END) AS inner_losses FROM r GROUP BY site)
    SELECT site, (total > 0)::INTEGER::BIGINT AS gains, CASE WHEN total <= 1 THEN 0 WHEN with_ones = 1 THEN inner_losses ELSE inner_losses + without END::BIGINT AS losses FROM t""",
)


def _ordered_costs(s, n=4):
    x = s.range(n).select(F.col("id").cast("int").alias("s"))
    y = s.range(n).select(F.col("id").cast("int").alias("r"))
    return x.join(F.broadcast(y)).select("s", "r", F.abs(F.col("s") - F.col("r")).cast("long").alias("step"))


def _sankoff_sql(view: str, costs: str) -> str:
    return f""", c AS ({costs}), low AS (SELECT region, site, c.s AS state, sum(step) AS cost FROM {view} JOIN c ON c.r = {view}.state GROUP BY ALL),
    up AS (SELECT site, c.s, region, min(cost + step) AS m FROM low JOIN c ON c.r = low.state GROUP BY ALL), root AS (SELECT site, s, sum(m) AS cost FROM up GROUP BY ALL)
    SELECT site, min(cost)::BIGINT AS cost FROM root GROUP BY site"""


add(
    "sankoff_ordered",
    lambda s, d: T.sankoff(E.tree(s, d), _leaves(s, d), _ordered_costs(s)),
    f"WITH {E.SITES_SQL}{_sankoff_sql('sites', 'SELECT a AS s, b AS r, abs(a - b) AS step FROM (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b)')}",
)
add("genetic_code_steps", lambda s, d: steps(s), steps_sql())


def _protein_costs(s):
    code = F.instr(F.lit(AMINO), F.col("a")) - 1
    return steps(s).select(code.alias("s"), (F.instr(F.lit(AMINO), F.col("b")) - 1).alias("r"), "step")


add(
    "protein_parsimony",
    lambda s, d: T.sankoff(E.tree(s, d), E.residues(s, d).select(F.col("taxon").alias("node"), "site", "state"), _protein_costs(s)),
    f"WITH {E.RESIDUES_SQL}{_sankoff_sql('residues', f'''SELECT instr('{AMINO}', a) - 1 AS s, instr('{AMINO}', b) - 1 AS r, step FROM ({steps_sql()})''')}",
)


def _likelihood_sql(name: str, rates: tuple[float, ...]) -> str:
    listed = ", ".join(f"{r}e0" for r in rates)
    bl = "0.05e0 + 0.01e0 * ({} % 7)"
    return f"""{name}_rates AS (SELECT unnest([{listed}]) AS rate), {name}_x AS (SELECT unnest([0, 1, 2, 3]) AS x),
{name}_low AS (SELECT rate, region, site, x, product(0.25e0 * (1 - exp(-4e0 / 3 * rate * ({bl.format("taxon")}))) + CASE WHEN state = x THEN exp(-4e0 / 3 * rate * ({bl.format("taxon")})) ELSE 0 END) AS l FROM sites, {name}_rates, {name}_x GROUP BY ALL),
{name}_top AS (SELECT rate, site, x, product(0.25e0 * (1 - exp(-4e0 / 3 * rate * ({bl.format("region")}))) * total + exp(-4e0 / 3 * rate * ({bl.format("region")})) * l) AS l
      FROM (SELECT *, sum(l) OVER (PARTITION BY rate, region, site) AS total FROM {name}_low) GROUP BY ALL),
{name} AS (SELECT site, round(ln(sum(0.25e0 * l) / {len(rates)}), 6) AS lnl FROM {name}_top GROUP BY site)"""


ONE_SQL, GAMMA_SQL = _likelihood_sql("one", (1.0,)), _likelihood_sql("four", GAMMA_RATES)
add("pruning_lnl", lambda s, d: T.site_likelihoods(E.tree(s, d), _leaves(s, d)), f"WITH {E.SITES_SQL}, {ONE_SQL} SELECT * FROM one")
add("gamma_lnl", lambda s, d: T.site_likelihoods(E.tree(s, d), _leaves(s, d), GAMMA_RATES), f"WITH {E.SITES_SQL}, {GAMMA_SQL} SELECT * FROM four")
# Published amino-acid frequencies of the WAG model, in the order of WAG_ORDER.
WAG_ORDER = "ARNDCQEGHILKMFPSTWYV"
WAG = (0.0866279, 0.043972, 0.0390894, 0.0570451, 0.0193078, 0.0367281, 0.0580589, 0.0832518, 0.0244313, 0.048466, 0.086209, 0.0620286, 0.0195027, 0.0384319, 0.0457631, 0.0695179, 0.0610127, 0.0143859, 0.0352742, 0.0708956)
POISSON = (0.05,) * 20


def _protein_sql(frequencies: tuple[float, ...]) -> str:
    pi = f"([{', '.join(f'{f!r}e0' for f in frequencies)}])[x + 1]"
    e = "exp(-(0.05e0 + 0.01e0 * ({} % 7)))"
    return f"""WITH {E.RESIDUES_SQL}, x AS (SELECT unnest(generate_series(0, 19))::INTEGER AS x),
      seen AS (SELECT taxon, region, site, state, ([{", ".join(f"{f!r}e0" for f in frequencies)}])[state + 1] AS f FROM residues),
    low AS (SELECT region, site, x, product((1 - {e.format("taxon")}) * f + CASE WHEN state = x THEN {e.format("taxon")} ELSE 0 END) AS l FROM seen, x GROUP BY ALL),
    top AS (SELECT site, x, product((1 - {e.format("region")}) * m + {e.format("region")} * l) AS l FROM (SELECT *, sum(l * {pi}) OVER (PARTITION BY region, site) AS m FROM low) GROUP BY ALL)
    SELECT site, round(ln(sum(l * {pi})), 6) AS lnl FROM top GROUP BY site"""


for name, frequencies in (("poisson", POISSON), ("wag", tuple(f / sum(WAG) for f in WAG))):
    add(
        f"protein_{name}_lnl",
        lambda s, d, f=frequencies: T.site_likelihoods(E.tree(s, d), E.residues(s, d).select(F.col("taxon").alias("node"), "site", "state"), frequencies=f, speed=1.0),
        _protein_sql(frequencies),
    )

add(
    "patristic",
    lambda s, d: T.patristic(E.tree(s, d)),
    """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, 0.05e0 + 0.01e0 * (n_nationkey % 7) AS bl, 0.05e0 + 0.01e0 * (n_regionkey % 7) AS rb FROM nation)
    SELECT a.k AS i, b.k AS j, round(a.bl + b.bl + CASE WHEN a.r = b.r THEN 0 ELSE a.rb + b.rb END, 6) AS d FROM n a JOIN n b ON a.k < b.k""",
)
add(
    "tree_heights",
    lambda s, d: T.heights(E.tree(s, d)),
    f"""WITH {E.TREE_SQL}, n AS (SELECT t.node, t.parent, t.bl, p.bl AS pb FROM tree t JOIN tree p ON t.parent = p.node WHERE t.level = 2),
      r AS (SELECT parent AS node, max(bl) AS h, max(pb) AS pb FROM n GROUP BY parent)
    SELECT node, 0e0 AS height, round(bl + pb, 6) AS to_root FROM n UNION ALL SELECT node, round(h, 6), round(pb, 6) FROM r UNION ALL SELECT -1, round(max(h + pb), 6), 0e0 FROM r""",
)
add(
    "lowest_common_ancestor",
    lambda s, d: T.lca(E.tree(s, d), E.tree(s, d).where("level = 2").select(F.col("node").alias("i")).join(F.broadcast(E.tree(s, d).where("level = 2").select(F.col("node").alias("j"))), F.expr("i < j"))),
    "SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE WHEN a.n_regionkey = b.n_regionkey THEN a.n_regionkey + 100 ELSE -1 END AS lca FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
)

LABEL_HEIGHT = 8  # in SQL: of a heap of up to 255 labels; levels that a smaller tree lacks are empty


def _contrasts_sql() -> str:
    """Levels from the tips up, each a common table expression."""
    out = [f"{E.TRAITS_SQL}, {E.LABEL_TREE_SQL}, up_{LABEL_HEIGHT + 1} AS (SELECT NULL::INTEGER AS node, NULL::INTEGER AS char, NULL::DOUBLE AS x, NULL::DOUBLE AS extra, NULL::DOUBLE AS contrast, NULL::DOUBLE AS variance WHERE false)"]
    for level in range(LABEL_HEIGHT, -1, -1):
        below = f"""SELECT parent AS node, char, max(x) FILTER (ord = 0) AS x0, max(x) FILTER (ord = 1) AS x1, max(bl + extra) FILTER (ord = 0) AS v, max(bl + extra) FILTER (ord = 1) AS w
          FROM up_{level + 1} u JOIN label_tree t ON u.node = t.node GROUP BY ALL"""
        out.append(f"""up_{level} AS (SELECT t.node, char::INTEGER AS char, value AS x, 0e0 AS extra, NULL::DOUBLE AS contrast, NULL::DOUBLE AS variance FROM label_tree t
      JOIN traits ON t.label = taxon WHERE level = {level}
          UNION ALL SELECT node, char, (x0 / v + x1 / w) / (1 / v + 1 / w), v * w / (v + w), (x0 - x1) / sqrt(v + w), v + w FROM ({below}))""")
    every = " UNION ALL ".join(f"SELECT char, node AS k, contrast, variance FROM up_{level} WHERE contrast IS NOT NULL" for level in range(LABEL_HEIGHT + 1))
    return ", ".join(out) + f", c AS ({every})"


def _contrasts(s, d):
    tree = E.label_tree(s, d)
    traits = E.traits(s, d).join(F.broadcast(tree.where("label is not null").select("node", F.col("label").alias("taxon"))), "taxon")
    return T.tree_contrasts(tree, traits)


CONTRASTS_SQL = f"WITH {_contrasts_sql()}"
add("contrasts", lambda s, d: _contrasts(s, d).select("char", "k", F.round("contrast", 6).alias("contrast")), f"{CONTRASTS_SQL} SELECT char, k, round(contrast, 6) AS contrast FROM c")
add(
    "contrast_correlations",
    lambda s, d: T.contrast_correlations(_contrasts(s, d)),
    f"{CONTRASTS_SQL} SELECT x.char AS a, y.char AS b, round(sum(x.contrast * y.contrast) / sqrt(sum(x.contrast * x.contrast) * sum(y.contrast * y.contrast)), 6) AS r FROM c x JOIN c y ON x.k = y.k AND x.char < y.char GROUP BY ALL",
)
add(
    "brownian_rates",
    lambda s, d: T.brownian_lnl(_contrasts(s, d)),
    f"""{CONTRASTS_SQL} SELECT char, round(sum(contrast * contrast) / count(*), 8) AS rate,
    round(-0.5e0 * (count(*) * ln(2 * pi()) + sum(ln(variance)) + count(*) * ln(sum(contrast * contrast) / count(*)) + count(*)), 6) AS lnl FROM c GROUP BY char""",
)


def _positions(s, d):
    return E.table(s, d, "part").select(F.col("p_partkey").alias("pos"))


POSITIONS_SQL = "n AS (SELECT count(*) AS n FROM part), pos AS (SELECT p_partkey AS pos FROM part), reps AS (SELECT unnest(generate_series(1, {})) AS rep)"
HASH = "(('0x' || substr(md5({}), 1, 8))::BIGINT % n)"
BOOT_SQL = f"{POSITIONS_SQL.format(20)}, w AS (SELECT rep::INTEGER AS rep, p AS pos, count(*) AS w FROM (SELECT rep, {HASH.format(chr(39) + 'boot:' + chr(39) + ' || rep || ' + chr(39) + ':' + chr(39) + ' || pos')} AS p FROM pos, reps, n) GROUP BY ALL)"
add("bootstrap_weights", lambda s, d: R.bootstrap_weights(_positions(s, d), 20), f"WITH {BOOT_SQL} SELECT * FROM w")
add(
    "block_bootstrap",
    lambda s, d: R.block_weights(_positions(s, d), 20, 10),
    f"""WITH {POSITIONS_SQL.format(20)}, b AS (SELECT rep, n, ('0x' || substr(md5('block:' || rep || ':' || pos), 1, 8))::BIGINT % n AS start FROM pos, reps, n WHERE pos < n // 10)
    SELECT rep::INTEGER AS rep, (start + k) % n AS pos, count(*) AS w FROM b, (SELECT unnest(generate_series(0, 9)) AS k) GROUP BY ALL""",
)
add(
    "jackknife",
    lambda s, d: R.jackknife_weights(_positions(s, d), 10),
    f"""WITH {POSITIONS_SQL.format(10)} SELECT rep::INTEGER AS rep, pos, 1::BIGINT AS w FROM (SELECT rep, pos, n, row_number() OVER (PARTITION BY rep ORDER BY md5('jack:' || rep || ':' || pos), pos) AS r FROM pos, reps, n) WHERE r <= floor(n * 0.5e0 + 0.5e0)""",
)


def _region_rows(s, d):
    """The regions' own sequences and the tree of regions alone."""
    tree = E.tree(s, d).where("level < 2")
    return tree, region_sites(s, d).select((F.col("taxon") + 100).alias("node"), "site", "state")


def _pattern_lnl(s, d):
    """Likelihood of the regions' sequences, one site of each pattern folded."""
    tree, leaves = _region_rows(s, d)
    return T.over_patterns(leaves, lambda chosen: T.site_likelihoods(tree, chosen)).select("site", "lnl")


def _pattern_weights(s, d):
    return T.patterns(_region_rows(s, d)[1])[1]


_RB = "exp(-4e0 / 3 * (0.05e0 + 0.01e0 * (taxon % 7)))"
add(
    "pattern_lnl",
    _pattern_lnl,
    f"""WITH {REGION_SITES_SQL}, l AS (SELECT site, x, product(0.25e0 * (1 - {_RB}) + CASE WHEN state = x THEN {_RB} ELSE 0 END) AS l FROM regions, (SELECT unnest([0, 1, 2, 3]) AS x) GROUP BY ALL)
    SELECT site, round(ln(sum(0.25e0 * l)), 6) AS lnl FROM l GROUP BY site""",
)
add(
    "pattern_weights",
    _pattern_weights,
    f"""WITH {REGION_SITES_SQL}, c AS (SELECT site, string_agg(taxon || ':' || state, ',' ORDER BY taxon) AS own FROM regions GROUP BY site)
    SELECT min(site) AS pattern, count(*) AS weight FROM c GROUP BY own""",
)


def _by_tree(s, d):
    """Site likelihoods of the tree, and of a star of all nations."""
    tree = E.tree(s, d)
    star = tree.where("level = 2").select("node", F.lit(-1).alias("parent"), "ord", "bl", F.lit(1).alias("level")).unionByName(tree.where("level = 0"))
    leaves = _leaves(s, d)
    own = T.site_likelihoods(tree, leaves).withColumn("tree", F.lit("regions"))
    return own.unionByName(T.site_likelihoods(star, leaves).withColumn("tree", F.lit("star"))).select("tree", F.col("site").alias("pos"), "lnl")


STAR_SQL = """star_x AS (SELECT unnest([0, 1, 2, 3]) AS x),
      star_l AS (SELECT site, x, product(0.25e0 * (1 - exp(-4e0 / 3 * (0.05e0 + 0.01e0 * (taxon % 7)))) + CASE WHEN state = x THEN exp(-4e0 / 3 * (0.05e0 + 0.01e0 * (taxon % 7))) ELSE 0 END) AS l FROM sites, star_x GROUP BY ALL),
lnl AS (SELECT 'regions' AS tree, site AS pos, lnl FROM one UNION ALL SELECT 'star', site, round(ln(sum(0.25e0 * l)), 6) FROM star_l GROUP BY site)"""
TAIL = "exp(-z * z / 2) / 2.5066282746310002e0 * t * (0.319381530e0 + t * (-0.356563782e0 + t * (1.781477937e0 + t * (-1.821255978e0 + t * 1.330274429e0))))"
add(
    "kh_test",
    lambda s, d: R.paired_test(_by_tree(s, d)),
    f"""WITH {E.SITES_SQL}, {ONE_SQL}, {STAR_SQL},
      s AS (SELECT a.tree AS t1, b.tree AS t2, sum(a.lnl - b.lnl) AS diff, avg(a.lnl - b.lnl) AS m, var_samp(a.lnl - b.lnl) AS v, count(*) AS n FROM lnl a
      JOIN lnl b ON a.pos = b.pos AND a.tree < b.tree GROUP BY ALL),
    q AS (SELECT t1, t2, diff, m / sqrt(v / n) AS z0 FROM s), r AS (SELECT *, abs(z0) AS z, 1 / (1 + 0.2316419e0 * abs(z0)) AS t
      FROM q) SELECT t1, t2, round(diff, 4) AS diff, round(z0, 4) AS z, round(2 * ({TAIL}), 4) AS p FROM r""",
)
add(
    "resampled_support",
    lambda s, d: R.resampled_support(_by_tree(s, d), R.bootstrap_weights(_positions(s, d), 20)),
    f"""WITH {E.SITES_SQL}, {ONE_SQL}, {STAR_SQL}, {BOOT_SQL}, s AS (SELECT rep, tree, round(sum(lnl * w), 6) AS l FROM lnl JOIN w ON lnl.pos = w.pos GROUP BY ALL),
      b AS (SELECT rep, arg_min(tree, -l) AS tree FROM s GROUP BY rep)
    SELECT t.tree, count(b.rep) AS wins, round(count(b.rep) / 20e0, 6) AS share FROM (SELECT DISTINCT tree FROM lnl) t LEFT JOIN b ON t.tree = b.tree GROUP BY t.tree""",
)
add(
    "plato_windows",
    lambda s, d: R.sliding_windows(T.site_likelihoods(E.tree(s, d), _leaves(s, d)).select(F.col("site").alias("pos"), "lnl"), 50, 10, 2.0),
    f"""WITH {E.SITES_SQL}, {ONE_SQL}, a AS (SELECT sum(lnl) AS total, count(*) AS n, max(site) AS e FROM one), k AS (SELECT unnest(generate_series(0, (SELECT e + 1 - 50 FROM a), 10)) AS start),
    w AS (SELECT start, count(*) AS n, sum(lnl) AS total, sum(lnl) - count(*) / (SELECT n FROM a)::DOUBLE * (SELECT total FROM a) AS delta FROM k
      JOIN one ON site >= start AND site < start + 50 GROUP BY start),
    z AS (SELECT *, round((delta - avg(delta) OVER ()) / stddev_samp(delta) OVER (), 4) AS z
      FROM w) SELECT start, n, round(total, 4) AS total, round(delta, 4) AS delta, z, abs(z) > 2 AS anomaly FROM z""",
)


def _models(s, d):
    tree, leaves = E.tree(s, d), _leaves(s, d)
    one = T.site_likelihoods(tree, leaves).select(F.lit("jc69").alias("model"), F.lit(30).cast("long").alias("k"), "lnl")
    four = T.site_likelihoods(tree, leaves, GAMMA_RATES).select(F.lit("jc69+gamma").alias("model"), F.lit(31).cast("long").alias("k"), "lnl")
    return one.unionByName(four).groupBy("model", "k").agg(F.sum("lnl").alias("lnl"), F.count("*").alias("n"))


add(
    "information_criteria",
    lambda s, d: R.information_criteria(_models(s, d)),
    f"""WITH {E.SITES_SQL}, {ONE_SQL}, {GAMMA_SQL}, m AS (SELECT 'jc69' AS model, sum(lnl) AS lnl, 30::BIGINT AS k, count(*) AS n FROM one
      UNION ALL SELECT 'jc69+gamma', sum(lnl), 31, count(*) FROM four),
    a AS (SELECT *, 2 * k - 2 * lnl AS aic FROM m), w AS (SELECT *, exp(-(aic - min(aic) OVER ()) / 2) AS e FROM a)
    SELECT model, round(lnl, 4) AS lnl, k, round(aic, 4) AS aic, round(aic + 2e0 * k * (k + 1) / (n - k - 1), 4) AS aicc, round(k * ln(n) - 2 * lnl, 4) AS bic, round(e / sum(e) OVER (), 6) AS weight FROM w""",
)


def _tips(s, d):
    customer = E.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("node"))
    first = E.table(s, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("node").agg((F.avg(F.unix_timestamp("o_orderdate").cast("double")) / 86400).alias("date"))
    return first.join(T.heights(E.tree(s, d)), "node")


add(
    "root_to_tip_slope",
    lambda s, d: _tips(s, d).agg(F.round(F.regr_slope("to_root", "date"), 8).alias("slope"), F.count("*").alias("n")),
    f"""WITH {E.TREE_SQL}, t AS (SELECT c_nationkey AS node, avg(epoch(o_orderdate)) / 86400e0 AS date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT round(regr_slope(x.bl + p.bl, date), 8) AS slope, count(*) AS n FROM t JOIN tree x ON x.node = t.node AND x.level = 2 JOIN tree p ON x.parent = p.node""",
)
