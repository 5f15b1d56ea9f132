"""Most likely distances against closed forms, the one-pair search and the ratio's definition."""

import numpy as np
import pytest

from cladespark import api
from cladespark.functions import likelihood as L
from cladespark.operators.ml_distances import fit, floored, ml_distances

NAMES = [f"c{a}{b}" for a in range(4) for b in range(4)]


def counts_of(seed, n):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 12, (n, 4, 4)) + np.eye(4, dtype=int) * rng.integers(0, 200, (n, 1, 1))
    own[0] = np.diag([5, 6, 7, 8])
    own[1] = rng.integers(50, 60, (4, 4))  # nothing in common
    return own


def test_jc69_is_the_closed_form():
    own = counts_of(1, 200)
    got = fit(own.astype(float), np.full((200, 4), 0.25), np.zeros(200))
    x = (4 * np.trace(own, axis1=1, axis2=2) / own.sum((1, 2)) - 1) / 3
    want = np.where(x > 0, np.minimum(-0.75 * np.log(np.maximum(x, 1e-9)), 10), 10)
    want[0] = 0
    assert got == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize(("pi", "ratio", "rates"), [((0.25,) * 4, 2.0, (1.0,)), ((0.4, 0.1, 0.2, 0.3), 4.0, (1.0,)), ((0.1, 0.4, 0.3, 0.2), 1.0, (0.2, 0.7, 2.1))])
def test_other_models_are_the_search_of_one_pair(pi, ratio, rates):
    own = counts_of(2, 40)
    k = L.excess(pi, ratio)
    got = fit(own.astype(float), np.broadcast_to(floored(np.array(pi)), (40, 4)), np.full(40, k), rates)
    model = L.Model(pi, float(k), rates)

    def lnl(counts, t):
        p = sum(L.Model(pi, float(k)).transition(r * t) for r in rates) / len(rates)
        return float((counts * np.log(p)).sum())

    for counts, t in zip(own[1:], got[1:], strict=True):
        if len(rates) == 1:
            assert t == pytest.approx(L.pair_distance(counts, model), rel=1e-4)
        assert t >= 9.99 or all(lnl(counts, t) >= lnl(counts, t * f) - 1e-9 for f in (0.9, 0.999, 1.001, 1.1))


@pytest.mark.parametrize("pi", [(0.25,) * 4, (0.4, 0.1, 0.2, 0.3), (0.05, 0.6, 0.15, 0.2)])
@pytest.mark.parametrize("ratio", [1.0, 2.0, 10.0])
def test_excess_gives_the_ratio(pi, ratio):
    """Over a short time the share of transitions over that of transversions is the ratio."""
    t = 1e-6
    p = L.Model(pi, float(L.excess(pi, ratio))).transition(t) * np.array(pi)[:, None]
    ts = p[0, 2] + p[2, 0] + p[1, 3] + p[3, 1]
    tv = p.sum() - np.trace(p) - ts
    assert ts / tv == pytest.approx(ratio, rel=1e-4) and ts + tv == pytest.approx(t, rel=1e-4)
    assert L.excess((0.25,) * 4, 2.0) == pytest.approx(1.5) and L.excess(pi, 0.01) == 0


def test_pairs_of_several_alignments(spark):
    rows = [(a, n, s) for a in ("x", "y") for n, s in (("A", "ACGTACGTAC"), ("B", "ACGTACGTAA"), ("C", "TCGTNCGAAA"), ("D", "NNNNNNNNNN"))]
    sequences = spark.createDataFrame(rows, "aln_id string, taxon string, seq string")
    got = {(r.aln_id, r.i, r.j): r.d for r in api.distances(sequences).collect()}
    closed = {(r.aln_id, r.i, r.j): r.d for r in api.distances(sequences, fit="closed").collect()}
    assert len(got) == 6 and got == {k: pytest.approx(v, abs=1e-7) for k, v in closed.items()}
    fixed = {(r.i, r.j): r.d for r in api.distances(sequences, "f84", frequencies=(0.4, 0.1, 0.2, 0.3), fit="closed").where("aln_id = 'x'").collect()}
    assert set(fixed) == {("A", "B"), ("A", "C"), ("B", "C")}
    empty = spark.createDataFrame([], ", ".join(["i string", "j string", *(f"{n} long" for n in NAMES)]))
    assert ml_distances(empty).count() == 0
    with pytest.raises(ValueError, match="model"):
        ml_distances(empty, "other")
