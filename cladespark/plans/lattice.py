"""Queries on sets of areas, and on seeded draws and running sums over sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import encode as E
from ..operators import areas as A
from ..operators import folds as T
from ..operators.replay import INCREMENT, MULTIPLIER, seeded_weights
from ..operators.running import running_sum
from .book import add
from .trees import FOREST_HEIGHT, ONE_SQL, _forest, _leaves

AREAS = 5
add(
    "area_bipartitions",
    lambda s, d: A.bipartitions(s, AREAS).join(_observed(s, d).select("mask").distinct(), "mask"),
    f"""WITH o AS (SELECT DISTINCT (1 << n_regionkey) | (1 << n_nationkey // 5 % {AREAS}) AS mask FROM nation), s AS (SELECT unnest(generate_series(1, {(1 << AREAS) - 1})) AS a)
    SELECT mask::BIGINT AS mask, a, (mask - a)::BIGINT AS b FROM o, s WHERE a & mask = a AND a < mask - a""",
)


def _observed(s, d):
    """A nation lives in its region, and in the area that a fifth of its key names."""
    bits = F.pow(F.lit(2.0), F.col("n_regionkey")).cast("long").bitwiseOR(F.pow(F.lit(2.0), F.floor(F.col("n_nationkey") / 5) % AREAS).cast("long"))
    return E.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), bits.alias("mask"))


def area_lattice(s, d):
    """Least-cost area histories on all trees of orders: each inner node's least cost below and the sets that have it."""
    found = A.best_sets(A.area_histories(_forest(s, d), _observed(s, d), AREAS))
    return found.select("tree", "node", F.col("cost").cast("long").alias("cost"), F.array_join(F.transform("best", lambda m: m.cast("string")), ",").alias("best"))


def _area_sql() -> str:
    step = "bit_count(t.mask & ~s.mask) + bit_count(s.mask & ~t.mask)"
    out = [
        f"""WITH {E.SLOTS_SQL}, s AS (SELECT unnest(generate_series(1, {(1 << AREAS) - 1})) AS mask), change AS (SELECT s.mask AS above, t.mask AS below, ({step})::BIGINT AS step FROM s, s t),
        h0 AS (SELECT tree, slot AS i, ((1 << n_regionkey) | (1 << n_nationkey // 5 % {AREAS}))::BIGINT AS mask, 0::BIGINT AS cost FROM slots JOIN nation ON n_nationkey = taxon)"""
    ]
    for k in range(1, FOREST_HEIGHT + 1):
        out.append(f"up{k} AS (SELECT tree, i, above AS mask, min(cost + step) AS cost FROM h{k - 1} JOIN change ON below = mask GROUP BY ALL)")
        whole = f"SELECT tree, i // 2 AS i, mask, sum(cost)::BIGINT AS cost FROM up{k} GROUP BY tree, i // 2, mask"
        met = "x.tree = y.tree AND x.i // 2 = y.i // 2 AND x.i <> y.i AND x.mask & y.mask = 0"
        parts = f"SELECT x.tree, x.i // 2 AS i, x.mask | y.mask AS mask, x.cost + y.cost AS cost FROM up{k} x JOIN up{k} y ON {met}"
        out.append(f"h{k} AS (SELECT tree, i, mask, min(cost) AS cost FROM ({whole} UNION ALL {parts}) GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT tree, {k} * {1 << 32} + i AS node, mask, cost FROM h{k}" for k in range(1, FOREST_HEIGHT + 1))
    best = f"SELECT *, min(cost) OVER (PARTITION BY tree, node) AS least FROM ({every})"
    return ",\n".join(out) + f"""\nSELECT tree, node::BIGINT AS node, cost, string_agg(mask::VARCHAR, ',' ORDER BY mask) AS best FROM ({best})
    WHERE cost = least GROUP BY tree, node, cost"""


add("area_lattice", area_lattice, _area_sql())

REPS, SEED = 20, 42


def seeded_bootstrap(s, d):
    """Bootstrap weights of the parts, as one run of the seeded generator draws them."""
    return seeded_weights(s, E.table(s, d, "part").count(), REPS, SEED)


def _seeded_sql(doublings: int = 22) -> str:
    """All states by doubling: those of the first steps, and the same so many steps on."""
    a, c, jumps = MULTIPLIER, INCREMENT, []
    for k in range(doublings):
        jumps.append(f"({k}, {a}::UHUGEINT, {c}::UHUGEINT)")
        a, c = a * a % (1 << 64), (a * c + c) % (1 << 64)
    table = f"jumps AS (SELECT * FROM (VALUES {', '.join(jumps)}) AS t(k, a, c))"
    head = f"WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), {table}, s AS (SELECT 0 AS k, 0::BIGINT AS step, {SEED}::UHUGEINT AS state"
    both = "unnest([{'step': step, 'state': state}, {'step': step + (1::BIGINT << s.k), 'state': (state * a + c) % 18446744073709551616::UHUGEINT}], recursive := true)"
    grow = f"SELECT s.k + 1, {both} FROM s JOIN jumps ON jumps.k = s.k, n WHERE (1::BIGINT << s.k) <= {REPS} * n"
    last = "SELECT * FROM s WHERE k = (SELECT max(k) FROM s)"
    return f"""{head} UNION ALL {grow}), every AS ({last}) SELECT ((step - 1) // n + 1)::INTEGER AS rep, (state % n::UHUGEINT)::BIGINT AS pos, count(*) AS w
    FROM every, n WHERE step > 0 AND step <= {REPS} * n GROUP BY ALL"""


add("seeded_bootstrap", seeded_bootstrap, _seeded_sql())


def cumulative_lnl(s, d):
    """Log-likelihood of the nations' tree summed up along the sites."""
    lnl = T.site_likelihoods(E.tree(s, d), _leaves(s, d)).select(F.col("site").alias("pos"), F.col("lnl").cast("decimal(20,6)").alias("lnl"))
    return running_sum(lnl, "lnl").select("pos", F.col("total").cast("double").alias("total"))


add("cumulative_lnl", cumulative_lnl, f"WITH {E.SITES_SQL}, {ONE_SQL} SELECT site AS pos, sum(lnl::DECIMAL(20, 6)) OVER (ORDER BY site)::DOUBLE AS total FROM one")
