"""Trees as text: writing node tables, the table function, consensus and scores of trees."""

import pytest

from cladespark import api
from cladespark.functions import newick
from cladespark.operators.newick_text import newick_texts

TEXTS = {1: "((A_b:1,B:2.5)x:0.5,C,(D:0.0000000001,E:10)0.75:0)root;", 2: "(A,B);", 3: "((A:0.25):0.125);", 4: "A;"}


def test_round_trip(spark):
    trees = spark.createDataFrame(list(TEXTS.items()), "tree int, newick string")
    nodes = newick.lateral_trees(trees)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, newick.explode_trees(trees).collect()))
    texts = newick_texts(nodes.withColumnRenamed("id", "node"))
    assert {r.tree: r.newick for r in texts.collect()} == {k: newick.write(newick.parse(t)) for k, t in TEXTS.items()} == TEXTS


def test_malformed_texts_have_no_nodes(spark):
    trees = spark.createDataFrame([(1, "(A,"), (2, None), (3, "(A,B);")], "tree int, newick string")
    assert {r.tree for r in newick.lateral_trees(trees).collect()} == {3}
    newick.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM newick_nodes('((A,B),C);')").first().n == 5


def test_consensus_of_texts(spark):
    rows = [(1, "((A:1,B:1):2,C:1,(D:1,E:1):1);"), (2, "((A:1,B:1):4,(C:1,D:1):1,E:1);"), (3, "((A:1,B:1):3,C:1,(D:1,E:1):3);")]
    trees = spark.createDataFrame(rows, "tree int, newick string")
    splits = {m: newick.split_sets(newick.parse(api.consensus(trees, m).first().newick)) for m in ("strict", "majority", "extended")}
    ab, de = frozenset("CDE"), frozenset("DE")
    assert splits["strict"] == {ab: pytest.approx(3)} and splits["majority"] == splits["extended"] == {ab: pytest.approx(3), de: pytest.approx(2)}
    assert "0.67" in api.consensus(trees).first().newick
    other = spark.createDataFrame([*rows, (4, "((A,B),C,(D,F));")], "tree int, newick string")
    with pytest.raises(ValueError, match="different taxa"):
        api.consensus(other)


def test_scores_of_trees(spark):
    rows = [("x", n, s) for n, s in (("A", "ACRT-"), ("B", "ACGTA"), ("C", "CAGTA"), ("D", "CAATN"))]
    sequences = spark.createDataFrame(rows, "aln_id string, taxon string, seq string")
    trees = spark.createDataFrame([(1, "((A:0.1,B:0.1):0.1,(C:0.1,D:0.1):0.1);"), (2, "((A,C),(B,D));")], "tree int, newick string")
    got = {r.tree: (r.steps, r.sites) for r in api.score_trees(sequences, trees).collect()}
    assert got == {1: (3, 5), 2: (5, 5)}
    lnl = {r.tree: r.lnl for r in api.score_trees(sequences, trees, "likelihood").collect()}
    want = api.evaluate(sequences, trees.first().newick, optimize=False).first().lnl
    assert lnl[1] == pytest.approx(want, abs=1e-5) and lnl[1] > lnl[2]
    for bad, said in (("((A,B),(C,X));", "X"), ("((A,B),C);", "D"), ("((A,B", "unreadable")):
        with pytest.raises(ValueError, match=said):
            api.score_trees(sequences, spark.createDataFrame([(7, bad)], "tree int, newick string"))
