"""Words that are alike against all pairs, classes and the matrix."""

import random

from cladespark.operators import cognates as C


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_alike_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 16))) for _ in range(150)}
    for w in list(words)[:80]:
        own = list(w)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(own) + 1)
            own[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        words.add("".join(own) or "x")
    frame = spark.createDataFrame([(w,) for w in [*words, *list(words)[:5], None, ""]], "word string").repartition(5)
    for per in (6, 3):
        want = sorted((a, b, distance(a, b)) for a in words for b in words if a < b and distance(a, b) <= max(len(a), len(b)) // per)
        assert want and sorted(map(tuple, C.alike(frame, per).collect())) == want


def test_components_of_chains(spark):
    nodes = spark.createDataFrame([(k,) for k in range(60)], "node int")
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(50, 45), (45, 55)], "a int, b int")
    got = {r.node: r["class"] for r in C.components(nodes, edges).collect()}
    assert got == {k: 10 if 10 <= k <= 40 else 45 if k in (45, 50, 55) else k for k in range(60)}


def test_matrix_of_languages(spark):
    docs = [(1, "en", "Father water"), (2, "de", "vaters wasser"), (3, "fr", "l'eau élan ELAN"), (4, None, "father"), (5, "es", None)]
    words = C.basic_words(spark.createDataFrame(docs, "doc_id int, lang string, text string"), share=0.5)
    assert {tuple(r) for r in words.collect()} == {("en", "father"), ("en", "water"), ("de", "vaters"), ("de", "wasser"), ("fr", "eau"), ("fr", "elan")}
    classes = C.cognate_classes(words, per=3)
    found = {(r.taxon, r.char): r.state for r in C.cognate_matrix(classes).collect()}
    assert found["en", "father"] == 1 and found["de", "father"] == 1 and found["fr", "father"] == 0
    assert C.cognate_matrix(classes.limit(0)).count() == 0
