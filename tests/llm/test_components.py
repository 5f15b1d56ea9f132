import random

import pytest

from cladespark.llm import components as module
from cladespark.llm.runtime import cut, small_side


def least(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("task_rows", [1 << 16, 50])
def test_components(spark, monkeypatch, task_rows):
    """One task for few edges, rounds of joins for many; chains, stars and a self link."""
    monkeypatch.setattr(module, "TASK_ROWS", task_rows)
    monkeypatch.setattr(module, "HELD", task_rows)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(600)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    frame = cut(spark.createDataFrame(edges, "a long, b long").repartition(7))
    rows = module.components(frame).collect()
    assert {r.node: r.component for r in rows} == least(edges) and len(rows) == len(least(edges))
    assert module.components(frame.limit(0)).count() == 0


def test_few_rows_are_few_partitions(spark):
    """Each partition of a small table is a task, a file and shuffle files in everything made from it."""
    many = cut(spark.range(2000).selectExpr("id as a", "id + 1 as b").repartition(150))
    assert many.rdd.getNumPartitions() == 150
    assert small_side(many).rdd.getNumPartitions() == 1
    assert module.components(many).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
