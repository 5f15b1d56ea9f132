"""Most likely distances of all pairs of sequences: Newton's method over batches of pair counts, many pairs at a time.

A pair is a row of sixteen counts, made by :func:`..operators.distances.pair_counts`; rows stay where they are and nothing is grouped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.likelihood import HIGH, LOW, excess
from ..session import workers_see_package

FLOOR = 1e-6  #: of a frequency
GROUP = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [1, 0, 1, 0], [0, 1, 0, 1]], float)


def floored(pi: np.ndarray) -> np.ndarray:
    pi = np.maximum(pi, FLOOR)
    return pi / pi.sum(-1, keepdims=True)


class Transitions:
    """Transition probabilities of F84 with frequencies ``pi`` (a row for each pair) and an excess of transitions, and their first two derivatives."""

    def __init__(self, pi: np.ndarray, k: np.ndarray, rates: Sequence[float]):
        self.drawn = np.broadcast_to(pi[:, None, :], (len(pi), 4, 4))
        self.within = GROUP * self.drawn / (pi @ GROUP)[:, :, None]
        q = self.drawn + k[:, None, None] * self.within
        speed = (pi[:, :, None] * q * (1 - np.eye(4))).sum((1, 2))
        self.slow, self.fast = 1 / speed, (1 + k) / speed
        self.rates = rates

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [np.zeros(self.drawn.shape) for _ in range(3)]
        for r in self.rates:
            a, b = -r * self.slow, -r * self.fast
            x, y = np.exp(a * t), np.exp(b * t)
            for order, total in enumerate(out):
                u, v = (x * a**order)[:, None, None], (y * b**order)[:, None, None]
                total += (v * np.eye(4) + (u - v) * self.within - u * self.drawn + (self.drawn if order == 0 else 0)) / len(self.rates)
        return tuple(out)


def fit(counts: np.ndarray, pi: np.ndarray, k: np.ndarray, rates: Sequence[float] = (1.0,), rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Most likely distances of pairs with ``counts`` (n x 4 x 4), in changes per site within ``LOW`` and ``HIGH``; 0 where all sites agree.

    The slope's sign keeps the maximum between two bounds; a Newton step that leaves them, or meets no maximum, is a bisection.
    """
    made = Transitions(pi, k, rates)

    def slopes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, d, dd = made.at(t)
        p = np.maximum(p, 1e-300)
        return (counts * d / p).sum((1, 2)), (counts * (dd / p - (d / p) ** 2)).sum((1, 2))

    n = len(counts)
    low, high = np.full(n, LOW), np.full(n, HIGH)
    rising = slopes(high)[0] >= 0
    t = np.full(n, 0.1)
    for _ in range(rounds):
        slope, bend = slopes(t)
        low, high = np.where(slope > 0, t, low), np.where(slope > 0, high, t)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = t - slope / bend
        fine = (bend < 0) & (step > low) & (step < high)
        after = np.where(fine, step, (low + high) / 2)
        still = np.abs(after - t) < tolerance
        t = after
        if still.all():
            break
    same = counts.sum((1, 2)) == np.trace(counts, axis1=1, axis2=2)
    return np.where(same, 0.0, np.where(rising, HIGH, t))


def ml_distances(
    counts: DataFrame, model: str = "jc69", frequencies: Sequence[float] | None = None, ratio: float = 2.0, rates: Sequence[float] = (1.0,), keys: Sequence[str] = ("i", "j")
) -> DataFrame:
    """``keys`` and ``d`` of every pair. ``counts``: ``keys`` and ``c00 .. c33``.

    ``model``: ``jc69``, ``k2p`` (equal frequencies), ``f81`` or ``f84``, whose ``frequencies`` of A, C, G, T are given or else each pair's own; ``ratio``: of transitions to
    transversions, for ``k2p`` and ``f84``. ``rates``: equally likely rates of sites. Pairs without common sites have no rows in ``counts``; those without a finite maximum get 10.
    """
    if model not in ("jc69", "k2p", "f81", "f84"):
        raise ValueError(f"no model: {model}")
    workers_see_package(counts.sparkSession)
    names = [f"c{a}{b}" for a in range(4) for b in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(n).to_numpy() for n in names], 1).astype(float).reshape(-1, 4, 4)
            if model in ("jc69", "k2p"):
                pi = np.full((len(own), 4), 0.25)
            elif frequencies is not None:
                pi = np.broadcast_to(floored(np.array(frequencies, float)), (len(own), 4))
            else:
                pi = floored((own.sum(1) + own.sum(2)) / (2 * own.sum((1, 2)))[:, None])
            k = excess(pi, ratio) if model in ("k2p", "f84") else np.zeros(len(own))
            columns = [*(batch.column(c) for c in keys), pa.array(fit(own, pi, k, rates))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "d"])

    schema = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in keys) + ", d double"
    return counts.select(*keys, *names).mapInArrow(run, schema)
