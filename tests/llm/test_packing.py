import itertools
import random
import zlib

import numpy as np
import pytest

from cladespark.llm import tokens
from cladespark.llm.packing import assign, pack, plan, reduce_instance


def optimum(lengths, capacity):
    """Fewest bins, by trying all assignments of small instances."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def check(lengths, capacity):
    sequence, offset = assign(np.array(lengths), capacity)
    for s in set(sequence.tolist()):
        rows = sorted((o, n) for q, o, n in zip(sequence, offset, lengths, strict=True) if q == s)
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(rows))
        assert sum(rows[-1]) <= capacity
    return len(set(sequence.tolist()))


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(250):
        capacity = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fixed = reduce_instance(counts, capacity)
        rest = [k for k in range(capacity + 1) for _ in range(counts[k])]
        assert sum(m for _, m in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)
        check(lengths, capacity)


def test_many_pieces_come_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.2, 20000).astype(int) + 1)
    used = check(lengths.tolist(), 2048)
    assert used <= 1.002 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é" * 10), (9, "word, " * 9000)]])
def test_query_shape(spark, rows):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), path, shard_pieces=3).collect()
    encode = tokens.Encoder(path)._tokenizer.encode
    want = []
    for doc_id, text in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(tuple, (r[:5] for r in got)), key=lambda r: (r[0] or -1, r[1])) == sorted(want, key=lambda r: (r[0] or -1, r[1]))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
