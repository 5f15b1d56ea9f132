import random
from collections import defaultdict
from hashlib import sha256

import pytest

from cladespark.llm.exact_dedup import ContentTable, exact_dedup, grace_fold

SCHEMA = "doc_id long, text string, digest string, content int, keep_id string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted((d, max(g), len(g), d == max(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


@pytest.mark.parametrize("memory", [64 << 20, 3000])
def test_against_brute_force(spark, memory):
    rng = random.Random(1)
    texts = ["", None, "é" * 5000, "long " * 20000] + [f"text {k}" for k in range(40)]
    rows = [(k, rng.choice(texts)) for k in range(600)] + [(1000 + k, "hot") for k in range(300)]
    frame = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, exact_dedup(frame, memory_bytes=memory).collect()))
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, "")]
    got = {tuple(r)[:4] for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 3, True), (None, 1, 3, False), (2, 3, 2, False), (3, 3, 2, True)}


def test_equal_keys_do_not_merge_contents(tmp_path):
    table = ContentTable()
    table.add("0" * 64, b"a", 1, 1)
    table.add("0" * 64, b"b", 2, 1)
    table.add("0" * 64, b"a", 3, 2)
    assert sorted(map(tuple, table.records)) == [("0" * 64, b"a", 3, 3), ("0" * 64, b"b", 2, 1)]
    records = [("0" * 64, bytes([k % 7]) * 50, k, 1) for k in range(70)]
    assert len(list(grace_fold(records, 500, str(tmp_path)))) == 7
    assert not list(tmp_path.iterdir())
