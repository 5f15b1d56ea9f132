import hashlib
import random
from collections import defaultdict
from math import floor, inf, nan

import numpy as np
import pytest

from cladespark.llm.vector_codes import Balls, squared, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int, error string, of int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:2])
    width = len(kept[0][1]) // 4
    books = [[v[p * width : p * width + width] for _, v, _ in kept[:entries]] for p in range(4)]

    def assign():
        out = []
        for _, v, _ in kept:
            best = []
            for p in range(4):
                x = v[p * width : p * width + width]
                best.append(min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v, _), best in zip(kept, assign(), strict=True):
            for p in range(4):
                members[p, best[p][1]].append(v[p * width : p * width + width])
        for (p, k), found in members.items():
            books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for (i, _, label), best in zip(kept, assign(), strict=True):
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        totals[label] += out[-1][2]
    return sorted((i, c, e, totals[label], digest) for i, c, e, label in out)


def corpus(seed, n, width=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    rows = [(k, [rng.gauss(c, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for k in range(n)]
    rows += [(n + k, rows[5][1], 9) for k in range(40)]  # equal vectors, also among the first entries
    rows += [(n + 50, None, 1), (n + 51, [nan] * width, 1), (n + 52, [inf] + [0.0] * (width - 1), 1), (n + 53, [None] + [0.0] * (width - 1), 1)]
    rows = rows[:3] + [(7000 + k, v, label) for k, v, label in rows[3:]] + [(3, rows[0][1], 1), (4, rows[0][1], 1)]
    rng.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize(("entries", "n"), [(256, 120), (16, 500)])
def test_against_brute_force(spark, entries, n):
    rows = corpus(n, n)
    got = vector_codes(frame_of(spark, rows).repartition(5), entries=entries).collect()
    assert sorted(map(tuple, got)) == brute(rows, entries)


def test_result_does_not_depend_on_partitions(spark):
    rows = corpus(3, 300)
    one, many = (sorted(map(tuple, vector_codes(frame_of(spark, rows).repartition(p), entries=32).collect())) for p in (1, 24))
    assert one == many


def test_rings_and_still_balls_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (4000, 4))
    before = np.concatenate([x[:60], x[:4], x[10:11]])
    own = squared(x, before).argmin(1)
    radii = np.full(len(before), -1)
    np.maximum.at(radii, own, ((x - before[own]) ** 2).sum(1))
    for change in (np.zeros_like(before), np.eye(len(before), 4, dtype=int) * 3, rng.integers(-5, 5, before.shape)):
        entries = before + change
        ball = Balls.of(entries, before, radii)
        assert (ball.nearest(x, own) == squared(x, entries).argmin(1)).all()
    assert Balls.of(before, before, radii).still.all()


def test_large_components_are_exact():
    x = np.array([[1 << 25, -(1 << 25)], [3, 4]])
    assert squared(x, x[::-1]).tolist() == [[((1 << 25) - 3) ** 2 + ((1 << 25) + 4) ** 2, 0], [0, ((1 << 25) - 3) ** 2 + ((1 << 25) + 4) ** 2]]


def test_empty_and_odd_tables(spark):
    assert vector_codes(frame_of(spark, [])).count() == 0
    assert vector_codes(frame_of(spark, [(1, None, 1), (2, [nan] * 4, 1)])).count() == 0
    same = [(None, [0.5] * 4, None), (None, [0.5] * 4, None), (1, [0.25] * 4, None), (1, [0.25] * 4, 2)]
    got = sorted(map(tuple, vector_codes(frame_of(spark, same)).collect()), key=str)
    assert [r[:4] for r in got] == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (None, "02020202", 0, 0), (None, "02020202", 0, 0)]
    for bad in ([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)], [(1, [0.5] * 6, 1)], [(1, [1e6] * 4, 1)]):
        with pytest.raises(ValueError, match="vectors of"):
            vector_codes(frame_of(spark, bad))
