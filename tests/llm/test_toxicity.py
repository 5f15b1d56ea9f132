import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.llm import toxicity as T

BAD = ["idiot", "worthless", "pathetic"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        own = [rng.choice(["the", "river", "is", "wide", "you", "and", "green", "Hills"]) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(BAD) + rng.choice(["", "s", "ly"]))
        docs.append((k, " ".join(own), "en", toxic))
        labels.append((k, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, score long")
    return frame, T.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark, fitted):
    frame, model = fitted
    got = T.score(frame, model).collect()
    assert len(got) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {d[0]: d[3] for d in corpus()[0]}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    clean = T.drop_toxic(frame, model)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_of_the_test_data(spark):
    """They never reach the fit, and the score tells them apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = [{r.doc_id: r.score for r in T.score(docs, T.fit(docs, own)).where("held_out").collect()} for own in (labels, turned)]
    assert found[0] == found[1]
    held = [(r.toxic, found[0][r.doc_id]) for r in labels.where("toxic is not null").collect() if r.doc_id in found[0]]
    bad, fine = ([x for toxic, x in held if toxic == k] for k in (1, 0))
    assert len(bad) > 3 and len(fine) > 30
    assert np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in fine]) >= 0.85


def test_rows_that_share_a_labelled_id(spark):
    rows = T.training_rows(spark.createDataFrame([(1, "b")] * 50 + [(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int"))
    assert [r.text for r in rows.collect()] in (["a"], [])  # or the id is held out


def test_odd_texts(spark, fitted):
    _, model = fitted
    rows = [(1, None), (None, ""), (2, " \n"), (3, "!!!"), (4, "w0rthless p*athetic id10t you!"), (4, "river " * 50000), (5, "İ" * 9)]
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) for r in got)
    assert T.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 0, None)], [(1, 0, 0), (2, 0, 0), (3, 0, 0)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [r.predicted for r in T.score(docs, model).collect()] == [0, 0]


def test_isotonic_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.integers(0, 12, 30).astype(float), rng.random(30)
        knots, values = T.isotonic(x, y)
        fit = values[np.searchsorted(knots, x)]
        assert (np.diff(values) > 0).all()
        xs = np.unique(x)
        mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
        for v, f in zip(x, fit, strict=True):
            assert f == pytest.approx(max(min(mean(a, b) for b in xs[xs >= v]) for a in xs[xs <= v]))
