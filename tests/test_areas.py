"""The lattice of areas and least-cost histories against enumeration."""

import itertools

import pytest
from pyspark.sql import functions as F

from cladespark.functions import biogeography as B
from cladespark.functions.newick import parse
from cladespark.operators import areas as A
from cladespark.operators import folds as T


def test_algebra_and_lattice(spark):
    row = spark.createDataFrame([(0b1101, 0b0110)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    found = row.select(A.union(a, b), A.intersection(a, b), A.difference(a, b), A.subset(a, b), A.subset(F.lit(4), a), A.disjoint(a, b), A.size(a), A.members(a, 4), A.of_members(F.array(F.lit(0), F.lit(3))))
    assert list(found.first()) == [15, 4, 9, False, True, False, 3, [0, 2, 3], 9]
    for k in (1, 2, 4):
        assert sorted(r.mask for r in A.subsets(spark, k).collect()) == list(range(1, 1 << k))
        want = [(m, x, m - x) for m in range(1, 1 << k) for x in range(1, m) if x & m == x and x < m - x]
        assert sorted(map(tuple, A.bipartitions(spark, k).collect())) == want
    assert all(r.mask.bit_count() <= 2 for r in A.bipartitions(spark, 4, most=2).collect())
    for bad in (0, 21):
        with pytest.raises(ValueError, match="areas"):
            A.subsets(spark, bad)


@pytest.mark.parametrize(("most", "costs"), [(None, (1.0, 1.0)), (2, (1.0, 1.0)), (None, (2.0, 0.5))])
def test_histories_are_those_of_one_tree(spark, most, costs):
    """A forest of two trees; each node's costs are those of the recursion over the whole tree."""
    texts = {"x": "(((a,b)d,c)e,(f,g)h)r;", "y": "((a,c)d,(b,(f,g)h)e)r;"}
    observed = {"a": 1, "b": 2, "c": 5, "f": 4, "g": 6}
    edges = []
    for tree, text in texts.items():
        root = parse(text)
        up = root.parents()
        edges += [(tree, n.name, up[n].name if n in up else None, up[n].children.index(n) if n in up else 0, 0.1) for n in root.preorder()]
    forest = T.with_levels(spark.createDataFrame(edges, "tree string, node string, parent string, ord int, bl double"))
    tips = spark.createDataFrame(list(observed.items()), "node string, mask int")
    found = A.area_histories(forest, tips, 3, *costs, most=most)
    best = {(r.tree, r.node): (r.cost, r.best) for r in A.best_sets(found).collect()}
    for tree, text in texts.items():
        root = parse(text)
        cost, sets = B.area_histories(root, observed, 3, *costs, max_areas=most)
        assert best[tree, "r"][0] == cost
        assert {n.name: s for n, s in sets.items()} == {node: own for (t, node), (_, own) in best.items() if t == tree}


def test_three_children(spark):
    edges = [("r", None, 0, 0)] + [(n, "r", k, 1) for k, n in enumerate("abc")]
    tree = spark.createDataFrame(edges, "node string, parent string, ord int, level int")
    with pytest.raises(ValueError, match="binary"):
        A.area_histories(tree, spark.createDataFrame([(n, 1) for n in "abc"], "node string, mask int"), 2)


def test_bipartitions_of_many_areas(spark):
    assert A.bipartitions(spark, 8).count() == sum(2 ** (m.bit_count() - 1) - 1 for m in range(1, 256))
    assert len(list(itertools.combinations(range(8), 2))) == A.bipartitions(spark, 8, most=2).count()
