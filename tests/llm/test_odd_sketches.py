import random
import re

import numpy as np
import pytest

from cladespark.llm import odd_sketches
from cladespark.llm.odd_sketches import BAND, BANDS, BITS, MOST_BITS, SAMPLES, alone_sizes, bands, bitmaps, differing_bits, near_duplicates, samples


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d), d == root(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(300)]
    docs, template = [], [rng.choice(vocabulary) for _ in range(90)]
    for k in range(260):
        kind = rng.random()
        if kind < 0.5:  # near copies, on either side of the threshold
            own = list(template)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5])):
                own[rng.randrange(90)] = rng.choice(vocabulary)
        elif kind < 0.7:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        else:
            own = [rng.choice(vocabulary[:3]) for _ in range(rng.randint(1, 7))]
        docs.append((k, " ".join(own)))
    docs += [(300 + k, docs[k][1].lower()) for k in range(20)] + [(400, None), (401, ""), (402, " \n\t"), (403, "a b"), (404, "A\tb"), (405, "x " * 30000), (406, "x " * 29000)]
    docs += [(500, " ".join(f"q{k}" for k in range(9000))), (501, " ".join(f"q{k}" for k in range(500, 9500)))]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("block", "seed"), [(256, 1), (4, 2)])
def test_against_brute_force(spark, monkeypatch, block, seed):
    monkeypatch.setattr(odd_sketches, "BLOCK", block)
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, 7, "x", True) for d, t in docs], "doc_id long, text string, n int, key string, c boolean").repartition(4)
    assert sorted(map(tuple, near_duplicates(frame).collect())) == brute(docs)


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "p q"), (None, "p q"), (None, "x"), (1, "a b c d e f g"), (1, "x y"), (2, "x y"), (3, "a b c d e f g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, 1, None, True), (None, 1, None, False), (None, 1, None, True), (1, 4, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 4, 1, False)]
    assert sorted(map(tuple, near_duplicates(frame).collect()), key=str) == sorted(want, key=str)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    """Copies with edits of their own: most link with the template, some with each other only, some with none."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(200)]
    docs = []
    for k in range(4000):
        own = list(template)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
            own[rng.randrange(len(own))] = f"v{k}-{rng.random()}"
        docs.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()}
    base, sets = shingles(" ".join(template)), {d: shingles(t) for d, t in docs}
    near = [d for d, s in sets.items() if 100 * len(s & base) >= 80 * len(s | base)]
    assert {got[d] for d in near} == {min(near)}
    far = sorted(set(sets) - set(near))
    assert len(far) > 500
    for d in rng.sample(far, 60):
        linked = [e for e, s in sets.items() if e != d and 100 * len(s & sets[d]) >= 80 * len(s | sets[d])]
        assert min([d, *linked]) == d if not linked else all(got[e] == got[d] for e in linked)
        assert linked or got[d] == d


def pair_at(rng, n, similarity):
    """Two sets of about ``n`` hashes at the least similarity that isn't below the given one."""
    union = rng.integers(0, 1 << 63, round(n * 2 / (1 + similarity)) or 1, dtype=np.uint64) * np.uint64(2)
    shared = int(np.ceil(similarity * len(union)))
    cut = shared + (len(union) - shared) // 2
    return np.sort(union[:cut]), np.sort(np.concatenate([union[:shared], union[cut:]]))


@pytest.mark.parametrize("n", [1, 5, 30, 128, 400, 1000, 20000])
def test_links_share_a_band_and_pass_by_their_bitmaps(n):
    rng = np.random.default_rng(n)
    pairs = [pair_at(rng, n, 0.8) for _ in range(300 if n < 5000 else 60)]
    flat = [s for p in pairs for s in p]
    value = samples(np.concatenate(flat), np.concatenate(([0], np.cumsum([len(s) for s in flat]))))
    a, b = value[::2], value[1::2]
    assert (bands(a) == bands(b)).any(1).all()
    assert np.bitwise_count(bitmaps(a) ^ bitmaps(b)).sum(1).max() <= MOST_BITS
    exact = np.mean([len(np.intersect1d(*p)) / len(np.union1d(*p)) for p in pairs])
    assert (a == b).mean() == pytest.approx(exact, abs=0.02)


def test_bitmaps_exclude_sets_far_below_the_threshold():
    rng = np.random.default_rng(9)
    sets = [s for _ in range(200) for s in pair_at(rng, 800, 0.5)]
    value = samples(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    assert np.bitwise_count(bitmaps(value[::2]) ^ bitmaps(value[1::2])).sum(1).min() > MOST_BITS
    assert differing_bits(0.8, 0) < MOST_BITS < differing_bits(0.6, 0)
    assert (1 - 0.8**BAND) ** BANDS < 1e-7 and BITS == 2 * SAMPLES


def test_shingles_that_no_other_document_has(spark):
    docs = corpus(7)
    sets = {d: shingles(t) for d, t in docs}
    counts = {}
    for s in sets.values():
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    got = {r.key: r.alone for r in alone_sizes(spark.createDataFrame([(d, t or "") for d, t in docs], "key long, text string").repartition(5)).collect()}
    assert got == {d: sum(counts[x] == 1 for x in s) for d, s in sets.items()}
