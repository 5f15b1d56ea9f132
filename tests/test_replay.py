"""Seeded draws against the generator run step by step, and running sums against a plain sum."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.operators import replay as R
from cladespark.operators.running import draw_positions, running_sum


def generator(seed):
    state = seed
    while True:
        state = (state * R.MULTIPLIER + R.INCREMENT) % (1 << 64)
        yield state


@pytest.mark.parametrize("seed", [0, 42, 12345, (1 << 64) - 1])
def test_states_of_any_step(seed):
    run = generator(seed)
    want = [seed, *(next(run) for _ in range(2000))]
    assert R.states(np.arange(2001), seed).tolist() == want
    far = R.states(np.array([1 << 40, (1 << 40) + 1]), seed)
    assert int(far[1]) == (int(far[0]) * R.MULTIPLIER + R.INCREMENT) % (1 << 64)
    assert len(R.states(np.array([], np.int64), seed)) == 0


@pytest.mark.parametrize(("block", "fraction"), [(1, 1.0), (7, 1.0), (1, 0.3)])
def test_weights_of_replicates(spark, block, fraction):
    n, reps, run = 53, 4, generator(42)
    want = {}
    for rep in range(1, reps + 1):
        counts = Counter()
        for _ in range(int(n * fraction + 0.5) // block):
            start = next(run) % n
            counts.update((start + k) % n for k in range(block))
        want |= {(rep, p): w for p, w in counts.items()}
    assert {(r.rep, r.pos): r.w for r in R.seeded_weights(spark, n, reps, 42, block, fraction).collect()} == want
    assert R.seeded_weights(spark, 0, 3).count() == 0


def test_uniform_draws_and_shuffle(spark):
    run = generator(7)
    want = [(next(run) >> 11) / (1 << 53) for _ in range(5)]
    got = spark.range(1, 6).select("id", R.uniform(F.col("id"), 7).alias("u")).orderBy("id").collect()
    assert [r.u for r in got] == want
    names, run = list("abcdefg"), generator(43)
    for k in range(6, 0, -1):
        j = next(run) % (k + 1)
        names[k], names[j] = names[j], names[k]
    assert R.shuffled(list("abcdefg"), 42) == names and R.shuffled([], 1) == []


@pytest.mark.parametrize(("width", "at_once"), [(4096, 1 << 20), (3, 1 << 20), (3, 5)])
def test_running_sums(spark, width, at_once):
    rng = random.Random(1)
    rows = [(k, p, rng.choice([None, 1, 2, 5])) for k in "ab" for p in rng.sample(range(-50, 400), 150)]
    found = running_sum(spark.createDataFrame(rows, "k string, pos long, w long").repartition(6), "w", keys=("k",), width=width, at_once=at_once)
    want, total = [], Counter()
    for k, p, w in sorted(rows, key=lambda r: r[:2]):
        total[k] += w or 0
        want.append((k, p, w, total[k]))
    assert sorted(map(tuple, found.select("k", "pos", "w", "total").collect()), key=lambda r: r[:2]) == want


def test_draws_by_weight(spark):
    weights = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 2.0), (5000, 5.0)], "pos long, w double")
    draws = spark.createDataFrame([(0.0,), (0.12,), (0.125,), (0.374,), (0.375,), (0.999,)], "u double")
    assert [r.pos for r in draw_positions(weights, draws).orderBy("u").collect()] == [0, 0, 2, 2, 5000, 5000]
