import random
import re
from hashlib import sha256

import pytest

from cladespark.llm.decontaminate import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item) if item_id is not None else []
            n = min(size, len(w))
            wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            for k in range(len(own) - n + 1) if n else ():
                if tuple(own[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    found.add(str(item_id))
        out.append((doc_id, len(own), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_against_brute_force(spark, block_words):
    rng = random.Random(4)
    vocabulary = ["a", "B", "ça", "É", "d1", "the", "xy"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 14, 30]))) for k in range(4, 12)] + [(12, None), (None, "a b"), (13, ""), (14, "the the"), (15, "the the")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(50, None), (51, ""), (52, "q" * 200000), (53, text(20) + items[6][1] + "zz"), (53, text(9)), (None, "the the")]
    docs += [docs[3], docs[3]] + [(100 + k, "pre " + items[5][1] + " post") for k in range(30)]
    frame = spark.createDataFrame([(d, t, "lang") for d, t in docs], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(frame, bench, block_words=block_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    clean = decontaminate(frame, bench, block_words=block_words)
    assert clean.columns == frame.columns
    flags = {(d, t): not any(r[5] for r in brute([(d, t)], items)) for d, t in docs}
    assert sorted((r.doc_id, r.text) for r in clean.where("doc_id is not null").collect() if r.text) == sorted((d, t) for d, t in docs if t and d is not None and flags[d, t])


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in contamination(docs, none).collect()] == [(1, 2, 0, 0)]
    assert contamination(docs.limit(0), none).count() == 0
