import random
import re

import pytest

from cladespark.llm import jaccard_join
from cladespark.llm.components import components
from cladespark.llm.jaccard_join import jaccard_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(300)]
    common = [rng.choice(vocabulary) for _ in range(25)]
    docs, template = [], [rng.choice(vocabulary) for _ in range(60)]
    for k in range(110):
        kind = rng.random()
        if kind < 0.4:  # near copies, at several distances
            own = list(template)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                own[rng.randrange(60)] = rng.choice(vocabulary)
        elif kind < 0.7:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
            own[rng.randint(0, len(own)) : 0] = common
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))] + common[: rng.randint(0, 25)]
        docs.append((k, " ".join(own)))
    docs += [(200 + k, docs[k][1].lower()) for k in range(20)] + [(300, None), (301, ""), (302, " \n\t"), (303, "a b"), (304, "A\tb"), (305, "x " * 30000), (306, "x " * 29000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("frequent", "seed"), [(48, 1), (3, 2), (8, 3)])
def test_against_brute_force(spark, frequent, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n int").repartition(4)
    assert sorted(map(tuple, jaccard_components(frame, frequent=frequent).collect())) == brute(docs)


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(frame).collect()), key=str) == [(2, 1, 2), (4, 1, 2), (None, 1, 2)]
    frame = spark.createDataFrame([(None, "p q"), (None, "p q"), (None, "x"), (1, "a b c d e f g"), (1, "x y"), (2, "x y"), (3, "a b c d e f g")], "doc_id long, text string")
    want = [(None, 1, None), (None, 1, None), (None, 1, None), (1, 3, 1), (1, 1, 1), (2, 1, 1), (3, 3, 1)]
    assert sorted(map(tuple, jaccard_components(frame).collect()), key=str) == sorted(want, key=str)
    assert jaccard_components(frame.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    """Every copy differs from the template in a few places of its own; some are too far from it to link."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(200)]
    docs = []
    for k in range(10_000):
        own = list(template)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9])):
            own[rng.randrange(len(own))] = f"v{k}-{rng.random()}"
        docs.append((k, " ".join(own)))
    base = shingles(" ".join(template))
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()}
    sets = {d: shingles(t) for d, t in docs}
    near = [d for d, s in sets.items() if 100 * len(s & base) >= 75 * len(s | base)]
    assert {got[d] for d in near} == {min(near)}  # a copy without an edit is the template itself
    far = [d for d in sets if d not in set(near)]
    assert len(far) > 500
    for d in rng.sample(far, 60):
        linked = [e for e, s in sets.items() if e != d and 100 * len(s & sets[d]) >= 75 * len(s | sets[d])]
        assert (got[d] != d or min([d, *linked]) == d) and all(got[e] == got[d] for e in linked)


def test_pairs_asked_in_portions(spark, monkeypatch):
    """However many pairs there are, texts meet by broadcasts of bounded portions and only those in a pair are shuffled."""
    monkeypatch.setattr(jaccard_join, "ASKED_ROWS", 40)
    docs = [(d, t or "") for d, t in corpus(4)[:60]]
    pairs = [(a, b) for a, _ in docs for b, _ in docs if a < b and (a + b) % 7 == 0]
    rows = spark.createDataFrame(docs, "key long, text string").repartition(3)
    found = jaccard_join.verified(spark.createDataFrame(pairs, "a long, b long"), rows).collect()
    sets = {d: shingles(t) for d, t in docs}
    want = {}
    for a, b in pairs:
        shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        want[a, b] = (round(1 - shared / union, 9) if union else 0.0, 100 * shared >= 75 * union)
    assert len(found) == len(pairs)
    assert {(r.a, r.b): (round(r.distance, 9), r.linked) for r in found} == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(7, 1000 + k) for k in range(60)] + [(5, 5), (2000, 1005)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 131)} | {1000 + k: 7 for k in range(60)} | {7: 7, 2000: 7}
