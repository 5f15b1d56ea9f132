"""Toxicity scores: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

The lexicon and the trees are learned here from labelled documents. Terms are words and their beginnings (so inflected
and run-together forms count), taken where they occur mostly in toxic documents. Features are densities of these terms,
their nearness to second-person words, capitals, punctuation and obfuscated spellings. Fitting uses at most ``max_rows`` labelled rows, those
with the least hash of their id; scoring reads every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

MAX_ROWS = 8000
LEXICON_TERMS = 4000
PREFIXES = (3, 4, 5, 6, 7, 8)
WINDOW = 40
FEATURES = 16

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vos vosotros".split())
# Signs that stand for letters in obfuscated spellings.
LEET = str.maketrans("013457@$!+|", "oieastasitl")

_WORD = re.compile(r"[^\W_]+(?:[@$!*+|'’]+[^\W_]+)*")
_RUN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """A word without masking signs, with letters for the digits and signs that stand for them."""
    return re.sub(r"[*'’]", "", word.translate(LEET))


def terms(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


class _Scores(dict):
    """Weight of a word: its heaviest term's; and whether the term shows only in the plain spelling."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, bool]:
        own = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        masked = False
        if not own and not word.isalpha():
            own = max((self.lexicon.get(t, 0.0) for t in terms(plain(word))), default=0.0)
            masked = own > 0
        if len(self) > 300_000:
            self.clear()
        self[word] = (own, masked)
        return own, masked


def features(text: str, scores: _Scores) -> list[float]:
    """Dense features of a whole text; all 0 for one without words."""
    found = _WORD.findall(text)
    if not found:
        return [0.0] * FEATURES
    n, lower = len(found), text.lower()
    low = _WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in found]
    weights = [scores[w] for w in low]
    hits = [k for k, (weight, _) in enumerate(weights) if weight]
    addressed = [k for k, w in enumerate(low) if w in SECOND_PERSON]
    near = 1e3
    if hits and addressed:
        at = np.searchsorted(addressed, hits)
        before, after = np.maximum(at - 1, 0), np.minimum(at, len(addressed) - 1)
        places = np.array(addressed)
        near = float(np.minimum(abs(places[before] - hits), abs(places[after] - hits)).min())
    densest = int((np.searchsorted(hits, np.array(hits) + WINDOW) - np.arange(len(hits))).max()) if hits else 0
    letters = sum(map(len, found))
    upper = sum(1 for a, b in zip(text, lower, strict=False) if a != b) if len(lower) == len(text) else sum(c.isupper() for c in text)
    total = sum(weights[k][0] for k in hits)
    return [
        float(np.log1p(n)), float(len(hits)), 1e3 * len(hits) / n, 1e3 * total / n, max((weights[k][0] for k in hits), default=0.0),
        float(len({low[k] for k in hits})), 1e3 * sum(weights[k][1] for k in hits) / n, float(densest), 1e3 * len(addressed) / n, min(near, 1e3),
        upper / letters, sum(w.isupper() and len(w) > 2 for w in found) / n, 1e3 * (text.count("!") + text.count("?")) / n,
        (len(text) - letters - text.count(" ")) / len(text), 1e3 * sum(not w.isalpha() for w in low) / n, 1e3 * len(_RUN.findall(text)) / n,
    ]


@dataclass
class Tree:
    """A complete binary tree: node k has children 2k+1 and 2k+2; ``value`` counts at the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at]


@dataclass
class Boosted:
    """Sum of trees for the log-odds, fitted to the logistic loss by second-order steps on quantile cuts."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    penalty: float = 1.0
    least: float = 3.0
    base: float = 0.0
    trees: tuple[Tree, ...] = ()

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 48)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, trees = float(np.log(rate / (1 - rate))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, cuts, p - y, np.maximum(p * (1 - p), 1e-6))
            trees.append(tree)
            margin += tree.predict(x, self.depth)
        self.trees = tuple(trees)
        return self

    def _grow(self, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        nodes = 2 ** (self.depth + 1) - 1
        tree = Tree(np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes))
        at = np.zeros(len(g), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            tree.value[node] = -self.rate * sum_g / (sum_h + self.penalty)
            if 2 * node + 2 >= nodes:
                continue
            best = (1e-9, 0, -1)
            for f, c in enumerate(cuts):
                left_g = np.cumsum(np.bincount(bins[rows, f], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bins[rows, f], h[rows], len(c) + 1))[:-1]
                right_g, right_h = sum_g - left_g, sum_h - left_h
                gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - sum_g**2 / (sum_h + self.penalty)
                gain[(left_h < self.least * 0.05) | (right_h < self.least * 0.05)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[2] >= 0:
                tree.feature[node], tree.cut[node] = best[1], cuts[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (bins[rows, best[1]] > best[2])
            else:
                at[rows] = 2 * node + 1
        return tree

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.base) + sum(t.predict(x, self.depth) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of ``x`` closest to ``y``, by pooling adjacent violators: knots and values."""
    knots, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # mean, weight, last knot
    for k, mean in enumerate(np.bincount(inverse, y) / weight):
        pools.append([float(mean), float(weight[k]), k])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, last = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * w) / (pools[-1][1] + w), pools[-1][1] + w, last]
    return knots[[p[2] for p in pools]], np.array([p[0] for p in pools])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; within a step the trees' own probability orders texts."""
        margin = self.trees.margin(x)
        step = self.values[np.minimum(np.searchsorted(self.knots, margin), len(self.values) - 1)]
        return np.clip(0.98 * step + 0.02 / (1 + np.exp(-margin)), 0, 1)


def _in_tasks(frame: DataFrame, function, schema: str) -> DataFrame:
    prepare(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def learn_lexicon(labelled: DataFrame, size: int = LEXICON_TERMS, least_docs: int = 6, least_share: float = 0.8) -> dict[str, float]:
    """Terms by weight. ``labelled``: ``text, toxic``. Each task adds up its documents' terms before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)})
        names = list(found[1])
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([found[1][t] for t in names], pa.int64()), "fine": pa.array([0] * len(names), pa.int64())})
        names = list(found[0])
        yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "bad": pa.array([0] * len(names), pa.int64()), "fine": pa.array([found[0][t] for t in names], pa.int64())})

    counts = _in_tasks(labelled, count, "term string, bad long, fine long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    share = F.col("bad") / (F.col("bad") + F.col("fine"))
    top = counts.where((F.col("bad") >= least_docs) & (share >= least_share)).orderBy(F.desc(F.col("bad") * share), "term").limit(size).collect()
    return {r.term: float(np.log((r.bad + 0.5) / (r.fine + 0.5))) for r in top}


def _matrix(frame: DataFrame, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(lexicon)
        for batch in batches:
            made = [features(t or "", scores) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "part"])

    rows = sorted(_in_tasks(frame.select("text", "toxic", "part"), make, "x array<double>, toxic int, part long").collect())
    return np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.toxic for r in rows], float), np.array([r.part for r in rows])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, toxic, part`` of at most ``max_rows`` labelled documents that aren't held out; of rows that share an id the least text counts."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("part", F.xxhash64("doc_id"))
    chosen = usable.orderBy("part", "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")).select("text", "toxic", "part")


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of at most ``max_rows`` labelled documents. With no label of either kind every score is the known share.

    One fold in six of the training rows is kept from lexicon and trees and calibrates.
    """
    rows = training_rows(docs, labels, max_rows)
    calibrating = F.pmod(F.col("part"), F.lit(6)) == 0
    lexicon = learn_lexicon(rows.where(~calibrating).select("text", "toxic"))
    x, y, part = _matrix(rows, lexicon)
    own = part % 6 == 0
    if not len(y) or y.min() == y.max() or len(set(y[~own])) < 2 or not own.any():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, Boosted(), np.zeros(1), np.array([share]))
    trees = Boosted().fit(x[~own], y[~own])
    knots, values = isotonic(trees.margin(x[own]), y[own])
    return Model(lexicon, trees, knots, values)


def _score_all(batches: Iterable[pa.RecordBatch], column: str, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    scores = _Scores(model.lexicon)
    for batch in batches:
        made = [features(t or "", scores) for t in batch.column(column).to_pylist()]
        yield batch, model.score(np.array(made).reshape(-1, FEATURES))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    A null text counts as empty, and an empty text is scored as one without any marks; a null id isn't held out;
    repeated rows each get their score; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _score_all(batches, "text", model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return _in_tasks(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _score_all(batches, text_col, model):
            yield batch.filter(pa.array(found < 0.5))

    return _in_tasks(docs, run, docs.schema)
