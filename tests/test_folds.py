"""Folds over small trees against direct computation."""

import math

import pytest

from cladespark.operators import folds as T

TREE = [(0, None, 0, 0.0, 0), (1, 0, 0, 0.3, 1), (2, 0, 1, 0.2, 1), (3, 1, 0, 0.1, 2), (4, 1, 1, 0.4, 2)]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, "node int, parent int, ord int, bl double, level int")


def test_tips_and_data(spark, tree):
    rows = lambda *n: spark.createDataFrame([(k,) for k in n], "node int")
    T.check_tips(tree, rows(2, 3, 4))
    for wrong in ((2, 3), (2, 3, 4, 9)):
        with pytest.raises(ValueError):
            T.check_tips(tree, rows(*wrong))


def _jc(states, rate=1.0):
    """Likelihood of one site by summing over the states of both inner nodes; ``states``: sets of states of tips 2, 3, 4."""
    p = lambda a, b, t: 0.25 + (0.75 if a == b else -0.25) * math.exp(-4 / 3 * rate * t)
    some = lambda a, k, t: sum(p(a, b, t) for b in states[k])
    return sum(0.25 * some(r, 2, 0.2) * sum(p(r, i, 0.3) * some(i, 3, 0.1) * some(i, 4, 0.4) for i in range(4)) for r in range(4))


def test_likelihoods_with_ambiguity_and_rates(spark, tree):
    sites = [({0}, {0}, {1}), ({0, 2}, {0}, {1, 3}), ({0, 1, 2, 3}, {2}, {2})]
    rows = [(tip, site, sum(1 << s for s in own)) for site, column in enumerate(sites) for tip, own in zip((2, 3, 4), column, strict=True)]
    leaves = spark.createDataFrame(rows, "node int, site int, mask int")
    for rates in ((1.0,), (0.3, 1.7)):
        got = {r.site: r.lnl for r in T.site_likelihoods(tree, leaves, rates).collect()}
        for site, column in enumerate(sites):
            want = math.log(sum(_jc(dict(zip((2, 3, 4), column, strict=True)), r) for r in rates) / len(rates))
            assert got[site] == pytest.approx(want, abs=1e-6)


def test_many_tips(spark):
    star = [(0, None, 0, 0.0, 0)] + [(k, 0, k, 5.0, 1) for k in range(1, 2000)]
    tree = spark.createDataFrame(star, "node int, parent int, ord int, bl double, level int")
    leaves = spark.createDataFrame([(k, 0, k % 4) for k in range(1, 500)], "node int, site int, state int")
    assert T.site_likelihoods(tree, leaves).first().lnl == pytest.approx(499 * math.log(0.25), rel=1e-3)


def test_step_matrices_at_several_levels(spark, tree):
    costs = spark.createDataFrame([(a, b, 0 if a == b else a + 2 * b + 1) for a in range(3) for b in range(3)], "s int, r int, step int")
    table = {(a, b): 0 if a == b else a + 2 * b + 1 for a in range(3) for b in range(3)}
    leaves = spark.createDataFrame([(2, 0, 0), (3, 0, 1), (4, 0, 2)], "node int, site int, state int")
    want = min(table[r, 0] + min(table[r, i] + table[i, 1] + table[i, 2] for i in range(3)) for r in range(3))
    assert [tuple(r) for r in T.sankoff(tree, leaves, costs).collect()] == [(0, want)]


def test_contrasts_of_three_tips(spark, tree):
    traits = spark.createDataFrame([(2, 0, 5.0), (3, 0, 1.0), (4, 0, 2.0)], "node int, char int, value double")
    got = {r.k: (r.contrast, r.variance) for r in T.tree_contrasts(tree, traits).collect()}
    x, v = (1 / 0.1 + 2 / 0.4) / (1 / 0.1 + 1 / 0.4), 0.3 + 0.1 * 0.4 / 0.5
    assert got[1] == (pytest.approx(-1 / math.sqrt(0.5)), pytest.approx(0.5))
    assert got[0] == (pytest.approx((x - 5) / math.sqrt(v + 0.2)), pytest.approx(v + 0.2))


def test_forest_of_unlike_trees(spark):
    """Two trees over the same tips, of different heights, one with a node of three children; ambiguous and missing states."""
    edges = [("a", 9, None, 0, 0.0), ("a", 8, 9, 0, 0.3), ("a", 1, 8, 0, 0.1), ("a", 2, 8, 1, 0.2), ("a", 3, 9, 1, 0.4), ("a", 4, 9, 2, 0.1)]
    edges += [("b", 9, None, 0, 0.0), ("b", 7, 9, 0, 0.2), ("b", 6, 7, 0, 0.1), ("b", 1, 6, 0, 0.1), ("b", 3, 6, 1, 0.5), ("b", 2, 7, 1, 0.2), ("b", 4, 9, 1, 0.3)]
    forest = T.with_levels(spark.createDataFrame(edges, "tree string, node int, parent int, ord int, bl double"))
    assert {(r.tree, r.node): r.level for r in forest.collect()}["b", 3] == 3
    rows = [(t, site, (t * 7 + site * 5) % 15 + 1) for t in (1, 2, 3, 4) for site in (-3, 0, 5, 64, 200) if (t + site) % 4]
    leaves = spark.createDataFrame(rows, "node int, site int, mask int")
    children = {}
    for tree, node, parent, order, bl in edges:
        children.setdefault((tree, parent), []).append((order, node, bl))

    def fitch(tree, node, site, seen):
        if (tree, node) not in children:
            return seen.get((node, site), 15), 0
        mask, steps = 15, 0
        for _, child, _ in sorted(children[tree, node]):
            own, below = fitch(tree, child, site, seen)
            steps += below + (not mask & own)
            mask = mask & own or mask | own
        return mask, steps

    def likelihood(tree, node, site, seen):
        if (tree, node) not in children:
            return [1.0 if seen.get((node, site), 15) >> k & 1 else 0.0 for k in range(4)]
        out = [1.0] * 4
        for _, child, bl in children[tree, node]:
            own, e = likelihood(tree, child, site, seen), math.exp(-4 / 3 * bl)
            out = [x * ((1 - e) * sum(own) / 4 + e * y) for x, y in zip(out, own, strict=True)]
        return out

    seen = {(t, site): mask for t, site, mask in rows}
    sites = {site for _, site, _ in rows}
    found = {(r.tree, r.site): (r["mask"], r.steps) for r in T.fitch(forest, leaves, root_only=True).collect()}
    assert found == {(t, x): fitch(t, 9, x, seen) for t in "ab" for x in sites}
    totals = {r.tree: (r.steps, r.sites) for r in T.fitch_scores(forest, leaves).collect()}
    assert totals == {t: (sum(fitch(t, 9, x, seen)[1] for x in sites), len(sites)) for t in "ab"}
    got = {(r.tree, r.site): r.lnl for r in T.site_likelihoods(forest, leaves).collect()}
    assert got == {(t, x): pytest.approx(math.log(sum(likelihood(t, 9, x, seen)) / 4), abs=1e-6) for t in "ab" for x in sites}


def test_nodes_without_a_root(spark):
    loop = spark.createDataFrame([("a", 1, None, 0, 0.0), ("a", 2, 3, 0, 0.1), ("a", 3, 2, 0, 0.1)], "tree string, node int, parent int, ord int, bl double")
    with pytest.raises(ValueError, match="root"):
        T.with_levels(loop)
