"""Weights of resampled sites are many times as large as the table of sites, which is what Spark estimates them by: no join may broadcast them."""

from collections import Counter, defaultdict

from cladespark import encode
from cladespark.operators import resampling
from cladespark.plans import kernels


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_support_merges_weights(spark, monkeypatch):
    lnl = [("a", 0, -1.0), ("a", 1, -4.0), ("b", 0, -2.0), ("b", 1, -2.0), ("c", 0, -1.0), ("c", 1, -4.0)]
    weights = [(1, 0, 2), (2, 1, 2), (3, 0, 1), (3, 1, 1), (4, 7, 2)]  # no tree has site 7
    lnl, weights = spark.createDataFrame(lnl, "tree string, pos long, lnl double"), spark.createDataFrame(weights, "rep int, pos long, w long")
    found = resampling.resampled_support(lnl, weights).collect()
    assert {(r.tree, r.wins, r.share) for r in found} == {("a", 1, 0.25), ("b", 2, 0.5), ("c", 0, 0.0)}
    monkeypatch.setattr(resampling, "cut", lambda frame: frame, raising=False)
    drawn = resampling.bootstrap_weights(spark.range(50).withColumnRenamed("id", "pos"), 3)
    made = plan(resampling.resampled_support(lnl, drawn))
    assert "SortMergeJoin [pos" in made and "BroadcastHashJoin [pos" not in made


def test_large_sides_of_dealt_joins_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(encode, "JOIN_ROWS", 10)
    x, y = spark.range(100).withColumnRenamed("id", "a"), spark.range(50).withColumnRenamed("id", "b")
    found = encode.dealt_join(x, y, "a", "b", (100, 50))
    assert found.count() == 50 and "Broadcast" not in plan(found)


def test_identity_of_resampled_sites(spark):
    """Against sums over sites, with weights of several binary digits, sites that a taxon lacks, and a pair without a drawn site."""
    state = lambda taxon, site: (site * (taxon + 3) // 5 + taxon * (site % 7 == 0)) % 4
    sites = [(t, s, state(t, s)) for t in range(4) for s in range(200) if (s + t) % 9 and (t < 3 or s == 199)]
    weights = [(rep, s, w) for rep in (1, 2) for s in range(0, 199) if (w := (s * rep) % 5 * (17 if s == 66 else 1))]
    own, drawn = defaultdict(dict), Counter()
    for t, s, x in sites:
        own[t][s] = x
    same = Counter()
    for rep, s, w in weights:
        for i in own:
            for j in own:
                if i < j and s in own[i] and s in own[j]:
                    drawn[rep, i, j] += w
                    same[rep, i, j] += w * (own[i][s] == own[j][s])
    found = resampling.resampled_identity(spark.createDataFrame(sites, "taxon int, site long, state int"), spark.createDataFrame(weights, "rep int, pos long, w long"))
    assert {(r.rep, r.i, r.j): (r.same, r.total) for r in found.collect()} == {k: (same[k], n) for k, n in drawn.items()}
    assert "SortMergeJoin [block" in plan(found)
    whole = plan(kernels.bootstrap_nj(spark, "/root/testdata/sf0.001", 2))
    assert "SortMergeJoin [block" in whole and "[pos" not in "".join(x for x in whole.splitlines() if "BroadcastHashJoin" in x)
