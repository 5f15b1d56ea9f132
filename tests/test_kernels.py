import math

import numpy as np
import pytest

from cladespark.functions import biogeography, clustering, comparative, likelihood, newick, parsimony, stats

# Published example data of five taxa (PHYLIP documentation, Felsenstein), sequences and 0/1 characters.
DNA5 = {"Alpha": "AACGTGGCCACAT", "Beta": "AAGGTCGCCACAC", "Gamma": "CAGTTCGCCACAA", "Delta": "GAGATTTCCGCCT", "Epsilon": "GAGATCTCCGCCC"}
MASKS = {n: np.array([1 << "ACGT".index(b) for b in s]) for n, s in DNA5.items()}
BINARY5 = {"Alpha": "01101001", "Beta": "01101010", "Gamma": "10011001", "Delta": "10011010", "Epsilon": "01110100"}
NAMES = ["a", "b", "c", "d", "e"]
ADDITIVE = newick.parse("((a:1,b:4):1,(c:2,d:3):2,e:5);")


def distances_of(root, names):
    x, branches = clustering._paths(root, names)
    out = np.zeros((len(names), len(names)))
    out[np.triu_indices(len(names), 1)] = x @ np.array([b.length for b in branches])
    return out + out.T


@pytest.mark.parametrize("text", ["(A,B);", "((A:1,B:2):0.5,C:3)root;", "(A_b,(C,D,E)x:1e-3);", "A;", "((A,B),(C,D));"])
def test_newick_round_trip(text):
    tree = newick.parse(text)
    assert newick.write(newick.parse(newick.write(tree))) == newick.write(tree)


@pytest.mark.parametrize("text", ["", "(A,B)", "((A,B);", "(A,B));", "(A:x,B);", "(A[c],B);", "(A,B);C"])
def test_newick_errors(text):
    with pytest.raises(newick.NewickError):
        newick.parse(text)
    assert newick.newick_nodes(text) is None


def test_robinson_foulds():
    p = newick.parse
    assert newick.robinson_foulds(p("((Alpha,Beta),(Gamma,(Delta,Epsilon)));"), p("((Alpha,Beta),(Delta,(Gamma,Epsilon)));")) == 2
    assert newick.robinson_foulds(p("(((A,B),C),(D,E));"), p("(((A,C),B),(D,E));")) == 2
    assert newick.robinson_foulds(ADDITIVE, ADDITIVE) == 0


def test_neighbor_joining_recovers_additive_distances():
    d = distances_of(ADDITIVE, NAMES)
    tree = clustering.neighbor_joining(NAMES, d)
    assert newick.robinson_foulds(tree, ADDITIVE) == 0
    assert np.allclose(distances_of(tree, NAMES), d)
    fitted, rest = clustering.fitch_margoliash(NAMES, d)
    assert rest < 1e-8 and np.allclose(distances_of(fitted, NAMES), d, atol=1e-3)


def test_upgma_and_kitsch_on_ultrametric_distances():
    root = newick.parse("((a:1,b:1):2,(c:2,d:2):1);")
    d = distances_of(root, NAMES[:4])
    for tree in (clustering.upgma(NAMES[:4], d), clustering.kitsch(NAMES[:4], d)[0]):
        assert comparative.is_ultrametric(tree) and np.allclose(distances_of(tree, NAMES[:4]), d)


# Published distances of seven primates.
def test_least_squares_on_primates():
    names = ["Bovine", "Mouse", "Gibbon", "Orang", "Gorilla", "Chimp", "Human"]
    low = [[1.6866], [1.7198, 1.5232], [1.6606, 1.4841, 0.7115], [1.5243, 1.4465, 0.5958, 0.4631], [1.6043, 1.4389, 0.6179, 0.5061, 0.3484], [1.5905, 1.4629, 0.5583, 0.4710, 0.3083, 0.2692]]
    d = np.zeros((7, 7))
    for i, row in enumerate(low, 1):
        d[i, :i] = row
    d += d.T
    # Published sums count each pair in both orders.
    assert 2 * clustering.fitch_margoliash(names, d)[1] == pytest.approx(0.01375, rel=0.01)
    assert 2 * clustering.kitsch(names, d)[1] == pytest.approx(0.107, rel=0.05)


def test_parsimony_scores():
    names = list(MASKS)
    assert parsimony.search(names, MASKS)[1] == 13
    found, best = parsimony.branch_and_bound(names, MASKS)
    assert best == 13 and all(parsimony.score(t, MASKS) == 13 for t in found)
    binary = {n: np.array([1 << int(c) for c in s]) for n, s in BINARY5.items()}
    assert parsimony.branch_and_bound(list(binary), binary)[1] == 10


def test_maximum_clique():
    columns = list(zip(*BINARY5.values(), strict=True))
    graph = [sum(1 << j for j, b in enumerate(columns) if i != j and len(set(zip(a, b, strict=True))) <= 3) for i, a in enumerate(columns)]
    best, _ = parsimony.maximum_clique(graph)
    assert len(best) >= 5
    assert parsimony.maximum_clique([0b110, 0b101, 0b011, 0])[0] == [0, 1, 2]


def test_transition_probabilities():
    for model in (likelihood.Model(), likelihood.Model((0.4, 0.1, 0.3, 0.2), 2.0)):
        p = model.transition(0.3)
        assert np.allclose(p.sum(1), 1) and (p > 0).all() and np.allclose(p, model.transition(0.1) @ model.transition(0.2))
        assert np.allclose(np.array(model.frequencies) @ p, model.frequencies)
    e = math.exp(-4 * 0.3 / 3)
    assert likelihood.Model().transition(0.3)[0, 0] == pytest.approx(0.25 + 0.75 * e)


def test_pruning_against_sum_over_states():
    tree = newick.parse("((Alpha:0.1,Beta:0.2):0.05,Gamma:0.3);")
    data = likelihood.Data.of({n: MASKS[n] for n in ("Alpha", "Beta", "Gamma")})
    model = likelihood.Model((0.3, 0.2, 0.3, 0.2), 1.0)
    p = {t: model.transition(t) for t in (0.1, 0.2, 0.05, 0.3)}
    want = 0.0
    for a, b, c in zip(*(DNA5[n] for n in ("Alpha", "Beta", "Gamma")), strict=True):
        a, b, c = ("ACGT".index(x) for x in (a, b, c))
        want += math.log(sum(model.frequencies[r] * p[0.3][r, c] * sum(p[0.05][r, x] * p[0.1][x, a] * p[0.2][x, b] for x in range(4)) for r in range(4)))
    assert likelihood.lnl(tree, data, model) == pytest.approx(want)


def test_search_recovers_simulated_tree():
    tree = newick.parse("((a:0.1,b:0.1):0.1,(c:0.1,d:0.1):0.1,e:0.2);")
    data = likelihood.Data.of(likelihood.simulate(tree, 1500, likelihood.Model(), 3))
    for moves in (likelihood.regrafts, likelihood.nni):
        found, value = likelihood.ml_search(NAMES, data, likelihood.Model(), moves)
        assert newick.robinson_foulds(found, tree) == 0 and value >= likelihood.lnl(tree, data, likelihood.Model())
    before = likelihood.lnl(tree, data, likelihood.Model())
    assert likelihood.optimize_lengths(tree, data, likelihood.Model(), rounds=2) >= before


def test_pair_distance_is_closed_form_for_jc69():
    counts = np.full((4, 4), 2.0) + np.diag([30.0] * 4)
    p = 24 / counts.sum()
    assert likelihood.pair_distance(counts, likelihood.Model()) == pytest.approx(-0.75 * math.log(1 - 4 * p / 3), rel=1e-4)
    assert likelihood.pair_distance(np.eye(4), likelihood.Model()) == 0


def test_statistics():
    assert stats.gamma_rates(0.5, 4) == pytest.approx([0.0334, 0.2519, 0.8203, 2.8944], abs=2e-4)
    assert stats.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    rng = np.random.default_rng(0)
    site = rng.normal(-3, 1, (3, 200))
    site[1] = site[0] - 0.5
    found = stats.au_test(site, reps=200)
    assert max(found, key=lambda r: r["lnl"])["au"] > 0.4 and found[1]["au"] < 0.05
    assert all(0 <= r[k] <= 1 for r in found for k in ("au", "bp", "kh", "sh"))


def test_contrasts():
    values = {"Alpha": [1.2, 3.4, 2.1], "Beta": [1.3, 3.2, 2.3], "Gamma": [2.1, 1.5, 3.8], "Delta": [2.3, 1.8, 3.5], "Epsilon": [1.1, 3.5, 2.0]}
    tree = newick.parse("(((Alpha:0.1,Beta:0.1):0.2,(Gamma:0.15,Delta:0.15):0.2):0.05,Epsilon:0.3);")
    r = comparative.correlations(comparative.contrasts(tree, values)[0])
    assert [r[0, 1], r[0, 2], r[1, 2]] == pytest.approx([-0.91061, 0.90002, -0.99943], abs=2e-5)
    found, variances = comparative.contrasts(newick.parse("((A:1.0,B:1.0):1.0,(C:1.5,D:0.5):1.0);"), {"A": [1.0], "B": [1.2], "C": [3.0], "D": [2.8]})
    assert len(found) == 3 and (variances > 0).all()
    assert math.isfinite(comparative.brownian_lnl(tree, values)[0])


def test_area_histories():
    two = newick.parse("((A,B),C);")
    assert biogeography.area_histories(two, {"A": 3, "B": 3, "C": 1}, 2)[0] == 1
    four = newick.parse("((A,B),(C,D));")
    assert biogeography.area_histories(four, {"A": 1, "B": 1, "C": 2, "D": 2}, 2)[0] == 0


@pytest.mark.parametrize(("text", "n"), [("((A,B),C);", 2), ("((A,B),(C,D));", 3)])
def test_reconciliation_of_equal_trees(text, n):
    host, parasite = newick.parse(text), newick.parse(text.replace("A", "a").replace("B", "b").replace("C", "c").replace("D", "d"))
    events, cost = biogeography.reconcile(host, parasite, {x.lower(): x for x in "ABCD"})
    assert events["cospeciation"] == n and sum(events.values()) == n and cost == 0


def test_dated_and_clock_trees():
    tree = newick.parse("((a:0.1,b:0.2):0.1,(c:0.3,d:0.1):0.05);")
    data = likelihood.Data.of(likelihood.simulate(tree, 300, likelihood.Model(), 1))
    value, rate, _ = comparative.date_tree(tree.copy(), data, likelihood.Model(), {"a": 2000.0, "b": 2005.0, "c": 2010.0, "d": 2001.0}, rounds=2)
    assert math.isfinite(value) and rate > 0
    clock = tree.copy()
    comparative.clock_lengths(clock, data, likelihood.Model(), rounds=3)
    assert comparative.is_ultrametric(clock, 1e-6)
