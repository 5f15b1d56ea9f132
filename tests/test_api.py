import json

import pytest

from cladespark import api
from cladespark.functions import newick
from cladespark.streaming.columns import base_counts, event_windows

from .test_kernels import DNA5


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([(a, n, s) for a in ("x", "y") for n, s in DNA5.items()], "aln_id string, taxon string, seq string")


def test_trees_per_alignment(sequences):
    for found in (api.distance(sequences), api.distance(sequences, "f81", "fm"), api.most_parsimonious(sequences, exact=True), api.maximum_likelihood(sequences.where("aln_id = 'x'"), "jc69")):
        rows = found.collect()
        assert rows and all({n.name for n in newick.parse(r.newick).leaves()} == set(DNA5) for r in rows)
    assert [r.steps for r in api.most_parsimonious(sequences).collect()] == [13, 13]


def test_support_and_evaluation(sequences):
    support = api.bootstrap(sequences, reps=5).collect()
    assert support and all(0 < r.support <= 1 for r in support)
    tree = "((Alpha:0.1,Beta:0.1):0.1,Gamma:0.2,(Delta:0.1,Epsilon:0.1):0.1);"
    assert all(a.lnl >= b.lnl for a, b in zip(api.evaluate(sequences, tree).orderBy("aln_id").collect(), api.evaluate(sequences, tree, optimize=False).orderBy("aln_id").collect(), strict=True))
    assert api.tree_distance(tree, tree) == {"rf": 0, "nrf": 0.0, "bsd": 0.0}


def test_other_searches(spark, sequences):
    binary = spark.createDataFrame([("x", n, b) for n, b in (("A", "110100"), ("B", "110000"), ("C", "001011"), ("D", "001001"), ("E", "000000"))], "aln_id string, taxon string, seq string")
    for score, steps in (("dollo", 6), ("camin_sokal", 6)):
        row = api.most_parsimonious_binary(binary, score).first()
        assert row.steps == steps and {n.name for n in newick.parse(row.newick).leaves()} == set("ABCDE")
    support = api.ml_bootstrap(sequences.where("aln_id = 'x'"), reps=3).collect()
    assert len(support) == 2 and all(0 <= r.support <= 100 for r in support)
    tests = spark.createDataFrame([("a", 0.5), ("b", 0.01)], "tree string, au double")
    assert [r.tree for r in api.au_confidence_set(tests).collect()] == ["a"]


def test_quartets_and_pairs(sequences):
    one = sequences.where("aln_id = 'x'")
    lake, cavender = api.invariants(one)
    assert lake.count() == cavender.count() == 5
    assert api.compatibility(one).count() == 78


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 4.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert base_counts(spark.createDataFrame([("A", 1, 0), ("A", 2, 0)], "taxon string, site int, state int")).first().n == 2


def test_json_calls(sequences):
    tree = "((Alpha:0.1,Beta:0.1):0.1,Gamma:0.2,(Delta:0.1,Epsilon:0.1):0.1);"
    told = lambda call, **options: {r.aln_id: json.loads(r.json) for r in api.json_call(call, sequences, **options).collect()}
    assert set(told("neighbor_joining")["x"]) == {"newick"} and told("parsimony")["y"]["steps"] == 13
    assert told("likelihood", tree=tree, optimize=False)["x"]["lnl"] < 0
    assert all(0 < s["support"] <= 1 for s in told("bootstrap", reps=3)["x"]["splits"])
    one = sequences.where("aln_id = 'x'")
    assert len(json.loads(api.json_call("quartets", one).first().json)["quartets"]) == 5
    for bad in ("quartets", "other"):
        with pytest.raises(ValueError):
            api.json_call(bad, sequences)


def test_taxa_that_differ(sequences):
    with pytest.raises(Exception, match="only in the tree or only in the alignment"):
        api.evaluate(sequences, "((Alpha,Beta),Gamma,(Delta,Zeta));").collect()
