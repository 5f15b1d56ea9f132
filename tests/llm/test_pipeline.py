import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladespark.llm import toxicity
from cladespark.llm.queries import ORACLES, QUERIES
from cladespark.llm.runtime import read

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import shingles

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def places(rows):
    """How many rows of each id and text."""
    found = {}
    for r in rows:
        found[r["doc_id"], r["text"]] = found.get((r["doc_id"], r["text"]), 0) + 1
    return found


def one_of_each(rows, linked, best):
    """Rows that stay when of each group of linked rows the best one does. ``rows``: (id, text)."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and linked(rows[i][1], rows[j][1]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {best([r for r, own in zip(rows, group, strict=True) if own == g]) for g in set(group)}


def as_pairs(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def near(a, b):
    s, t = shingles(a), shingles(b)
    return bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)


def smallest(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    assert list(STAGE) == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    kept = STAGE["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    kept = kept.cache()
    scores = toxicity.score(docs, toxicity.fit(docs, read(spark, SF, "labels")))
    assert places(kept.collect()) == places(docs.join(scores.where("score < 0.5").select("doc_id"), "doc_id").collect())
    assert 0 < kept.count() <= docs.count()

    own = {r.doc_id: r.text for r in kept.collect()}
    got = STAGE["exact_dedup"](spark, kept, SF)
    by_text = {}
    for d, t in own.items():
        by_text[t] = max(d, by_text.get(t, d))
    assert got.columns == docs.columns and as_pairs(got) == sorted(((d, own[d]) for d in by_text.values()), key=str)

    own = {d: own[d] for d in by_text.values()}
    got = STAGE["jaccard_join"](spark, got, SF)
    want = one_of_each(list(own.items()), near, smallest)
    assert got.columns == docs.columns and set(as_pairs(got)) == want

    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in contaminated(sorted(want), items) if not r[5]}
    got = STAGE["decontamination"](spark, got, SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == clean

    packed = corpus_pipeline.run(spark, SF)
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert {r.doc_id for r in packed.collect()} == clean
    assert all(r.n == r.end <= 2048 for r in sizes) and len(sizes) >= -(-sum(r.n for r in sizes) // 2048)


ODD = [
    (None, "only null one"), (None, "second null one"), (1, "dup text here"), (1, "other text"), (9, "dup text here"), (9, "dup text here"),
    (None, None), (None, None), (4, None), (5, ""), (None, "a b c d e f g h"), (None, "A b c d e f g h"), (7, "a b c d e f g  h"), (8, "x " * 30000), (8, "x " * 30001), (2, " "), (3, "\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    columns = "doc_id long, text string, row_key string, hashed int, id string, n int, digest int, component_id int"
    return spark.createDataFrame([(*r, f"k{k}", k, "i", 1, 2, 3) for k, r in enumerate(ODD)], columns).repartition(3).cache()


def test_exact_dedup_of_odd_rows(spark, odd):
    got = STAGE["exact_dedup"](spark, odd, SF)
    best = lambda rows: max(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = one_of_each(ODD, lambda a, b: (a or "") == (b or ""), best)
    assert got.columns == odd.columns and sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(((d, t or "") for d, t in want), key=str)


def test_jaccard_of_odd_rows(spark, odd):
    got = STAGE["jaccard_join"](spark, odd, SF)
    rows = [r for r in ODD if shingles(r[1])]
    want = sorted(((d, " ".join(t.split()).lower()) for d, t in one_of_each(rows, near, smallest)), key=str)
    assert got.columns == odd.columns
    assert sorted(((r.doc_id, " ".join(r.text.split()).lower()) for r in got.collect() if shingles(r.text)), key=str) == want
    assert got.where("text is null or trim(translate(text, '\n', ' ')) = ''").count() == len(ODD) - len(rows)


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_filters_of_odd_rows(spark, odd, name):
    got = STAGE[name](spark, odd, SF)
    assert got.columns == odd.columns and places(got.collect()) == places(odd.collect())


def test_packing_of_odd_rows(spark, odd):
    got = STAGE["packing"](spark, odd, SF).collect()
    starts = [r for r in got if r.piece == 0]
    assert sorted((r.doc_id for r in starts), key=str) == sorted((d for d, _ in ODD), key=str)
    assert sum(r.length for r in got if r.doc_id == 5) == 1


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables(spark, odd, name):
    assert STAGE[name](spark, odd.limit(0), SF).count() == 0


def test_queries_are_named_by_number():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1)) or len(QUERIES) < 10
