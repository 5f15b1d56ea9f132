"""Searches and tree building against exhaustive enumeration, and searches' helpers."""

import itertools

import numpy as np
import pytest

from cladespark.functions import searches as X
from cladespark.functions.newick import Node, parse, split_sets, write
from cladespark.functions.searches import _places
from cladespark.operators import splits as P
from cladespark.plans.scenarios import resistance
from cladespark.plans.searches import addition_orders, random_tree, step_search


def every_tree(names, rooted=False):
    first = 2 if rooted else 3
    trees = [Node(children=[Node(n) for n in names[:first]])]
    for n in names[first:]:
        trees = [t.copy() for s in trees for t in _places(s, Node(n), rooted)]
    return trees


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_searches_against_all_trees(seed):
    rng = np.random.default_rng(seed)
    names = list("ABCDEF")
    ordered = np.abs(np.subtract.outer(np.arange(5), np.arange(5)))
    masks = {n: 1 << rng.integers(0, 5, 30) for n in names}
    leaves = {n: X.leaf_costs(m, 5) for n, m in masks.items()}
    trees = every_tree(names)
    assert len(trees) == 105
    for steps in (ordered, 1 - np.eye(5, dtype=int)):
        tree, length = X.step_matrix_search(names, leaves, steps)
        least = min(X.sankoff_costs(t, leaves, steps).sum() for t in trees)
        assert least <= length == X.sankoff_costs(tree, leaves, steps).sum() <= least + 2  # random states: a search may end beside the best
        assert {n.name for n in tree.leaves()} == set(names)
    assert length == X.fitch_steps(tree, masks).sum()  # unordered steps, by either recursion
    found, most = X.hill_climb(names, lambda t: -int(X.compatible_columns(t, masks).sum()))
    best = max(X.compatible_columns(t, masks).sum() for t in trees)
    assert best - 1 <= -most == X.compatible_columns(found, masks).sum() <= best


def test_search_by_blocks_of_columns(spark):
    """Tasks of a few columns each find the kernel's trees, and the same where some states are unknown and columns repeat."""
    rng = np.random.default_rng(7)
    steps = np.abs(np.subtract.outer(np.arange(4), np.arange(4)))
    for n in (2, 7):
        states = {t: rng.integers(-1, 4, 90) for t in range(n)}
        states[0][:30] = -1  # no row at all
        rows = [(t, c, int(v)) for t, own in states.items() for c, v in enumerate(own) if v >= 0]
        found = step_search(spark.createDataFrame(rows, "taxon long, char long, state int"), steps, most=8).collect()
        masks = {str(t): np.where(v < 0, 15, 1 << np.maximum(v, 0)) for t, v in states.items()}
        orders = [[str(t) for t in range(n)]] + [[str(r.taxon) for r in addition_orders(spark.range(n).toDF("taxon")).where("start = 1").orderBy("place").collect()]]
        want = [X.step_matrix_search(order, {t: X.leaf_costs(m, 4) for t, m in masks.items()}, steps) for order in orders]
        best = min(range(2), key=lambda k: (want[k][1], k))
        assert [tuple(r) for r in found] == [(write(want[best][0]), want[best][1])]


def test_binary_scores_by_enumeration():
    """Dollo: the best node for the gain; irreversible: every set of branches that gain."""
    rng = np.random.default_rng(4)
    for tree in every_tree(list("ABCDE"), rooted=True)[::9]:
        states = {n: rng.integers(0, 2, 12) for n in "ABCDE"}
        nodes = list(tree.postorder())
        below = {id(n): {x.name for x in n.leaves()} for n in nodes}
        dollo, irreversible = X.dollo_steps(tree, states), X.camin_sokal_steps(tree, states)
        for c in range(12):
            ones = {n for n in states if states[n][c]}
            gains = [k for k in range(len(nodes) + 1) for own in itertools.combinations(nodes, k) if set().union(*(below[id(n)] for n in own)) == ones]
            assert irreversible[c] == min(gains)
            if not ones:
                assert dollo[c] == 0
                continue

            def losses(node, ones=ones):
                if not below[id(node)] & ones:
                    return 1
                return sum(losses(x) for x in node.children)

            assert dollo[c] == min(1 + losses(n) for n in nodes if ones <= below[id(n)])


def test_tree_of_splits():
    names = list("ABCDEF")
    tree = X.tree_of_splits([0b000110, 0b001110, 0b110000, 0b011000], names, lambda m: str(m.bit_count()), lambda m: float(m))
    assert split_sets(tree).keys() == {frozenset("BC"), frozenset("DE")}  # DE comes before EF and BCD, which don't fit it
    assert write(X.tree_of_splits([], names)) == "(A,B,C,D,E,F);"
    tree = X.tree_of_splits([0b000110, 0b001110, 0b110000], names, lambda m: str(m.bit_count()), lambda m: float(m))
    assert {n.name for n in tree.preorder() if n.children and n is not tree} == {"2", "3"} and split_sets(tree)[frozenset("BCD")] == 14


def test_consensus_of_trees(spark):
    rows = [(t, m, 1.0) for t, masks in (("a", (6, 14)), ("b", (6, 48)), ("c", (6, 24)), ("d", (24,))) for m in masks]
    splits = spark.createDataFrame(rows, "tree string, split long, bl double")
    found = P.consensus(splits, "extended", n_taxa=6)
    assert {r.split for r in found.collect()} == {6, 24}  # each twice or more; 14 and 48 don't fit them
    tree = {r.node: r.parent for r in P.consensus_tree(found, 6).collect()}
    assert tree == {1: 63, 2: 6, 4: 6, 8: 24, 16: 24, 32: 63, 6: 63, 24: 63, 63: None}
    with pytest.raises(ValueError):
        P.check_taxa(spark.createDataFrame([("a", 7), ("b", 15)], "tree string, mask long"))


def test_orders_and_random_trees(spark):
    taxa = spark.createDataFrame([(f"t{k}",) for k in range(6)], "taxon string")
    rows = addition_orders(taxa, 3).collect()
    orders = {s: [r.taxon for r in sorted((r for r in rows if r.start == s), key=lambda r: r.place)] for s in range(3)}
    assert orders[0] == sorted(orders[0]) and all(sorted(o) == orders[0] for o in orders.values()) and orders[1] != orders[2]
    root = random_tree(8, 3, 0.7)
    depth = {root: 0.0}
    for node in root.preorder():
        for child in node.children:
            depth[child] = depth[node] + child.length
    assert np.mean([depth[n] for n in root.leaves()]) == pytest.approx(0.7)
    assert resistance(parse("((A:1,B:1):0.5,C:1);")) == pytest.approx(0.5)
