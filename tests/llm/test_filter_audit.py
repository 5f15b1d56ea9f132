import random
import re
from collections import defaultdict
from itertools import permutations

from cladespark.llm.filter_audit import FILTERS, Diagram, adjacent_orders, all_orders, filter_audit

DOCS = "doc_id long, text string, lang string, mask int, part string, n long, id string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(docs):
    out = []
    for doc_id, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in docs)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e)
        out.append({name for name, failed in zip(FILTERS, tests, strict=True) if failed})
    return out


def brute(docs, labels):
    failed, parts = fails(docs), defaultdict(list)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for (doc_id, _, lang), f in zip(docs, failed, strict=True):
        parts[lang or ""].append((f, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    rows, shapley = [], defaultdict(int)
    for part, members in parts.items():
        for order in map("".join, permutations(FILTERS)):
            left = members
            for step, name in enumerate(order, 1):
                removed = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                failing = sum(name in m[0] for m in members)
                rows.append((part, order, step, len(left), len(removed), failing - len(removed), sum(m[0] == {name} for m in members), sum(m[1] for m in removed), sum(m[2] for m in removed)))
                shapley[part, name] += len(removed)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Élan", "Ünder", "日本"]
    docs = []
    for k in range(150):
        n = rng.choice([0, 1, 50, 199, 200, 201, 300])
        text = " ".join(rng.choice(words[: rng.choice([5, 100, 403])]) for _ in range(n))
        text = rng.choice([text, text.upper(), text + " # $5", "\n\t" + text + "\x0b"])
        docs.append((k * 3, text, rng.choice(["en", "de", None, ""])))
    docs += [(rng.choice([1, 500, 501, None, 3]), docs[rng.randrange(20)][1], rng.choice(["en", "fr"])) for _ in range(60)]
    docs += [(900, None, "en"), (901, "", "en"), (902, "A " * 60000, "fr"), (903, " ".join(["x"] * 300), "en")]
    rng.shuffle(docs)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in docs if rng.random() < 0.6]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(d, t, p, 1, "x", 2, "y") for d, t, p in docs], DOCS).repartition(5), spark.createDataFrame([(*r, "z") for r in labels], LABELS)


def test_against_brute_force(spark):
    docs, labels = corpus(1)
    assert sorted(map(tuple, filter_audit(*frames(spark, docs, labels)).collect())) == brute(docs, labels)


def test_hot_copies_and_empty_tables(spark):
    docs = [(k, "same text", "en") for k in range(3000)] + [(5000 + k, f"text {k}", "de") for k in range(10)]
    got = {tuple(r)[:5] for r in filter_audit(*frames(spark, docs, [])).where("filter_order = 'EABCD'").collect()}
    assert ("en", "EABCD", 1, 1, 2999) in got and ("de", "EABCD", 1, 10, 0) in got
    assert filter_audit(*frames(spark, [], [(1, 1, 1)])).count() == 0


def test_swaps_visit_every_order_once_and_keep_the_counts():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for level in adjacent_orders(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))
    assert len(set(all_orders())) == 120


def test_diagram_after_swaps_is_the_diagram_of_that_order():
    rng = random.Random(2)
    leaves = {m: (rng.randint(0, 3), 0, 1) for m in range(32) if rng.random() < 0.6}
    walked = Diagram([0, 1, 2, 3, 4], leaves, 3)
    for level in [0, 3, 1, 2, 2, 0, 1]:
        walked.swap(level)
        fresh = Diagram(walked.order, leaves, 3)
        assert list(walked.steps()) == list(fresh.steps())
        assert walked.weights[walked.root] == tuple(map(sum, zip(*leaves.values(), strict=True)))
