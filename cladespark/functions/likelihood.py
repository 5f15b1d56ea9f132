"""Maximum likelihood of trees in NumPy: column patterns with weights go through the tree together."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .newick import Node
from .parsimony import _placed, regrafts

LOW, HIGH = 1e-8, 10.0


def excess(frequencies, ratio: float):
    """The excess K of transitions that gives a ``ratio`` of transitions to transversions: K = (ratio piR piY - piA piG - piC piT) / (piA piG / piR + piC piT / piY).

    ``frequencies``: of A, C, G, T along the last axis. 0 where even no excess gives more transitions; at equal frequencies K is ratio - 1/2.
    This is the one place where a ratio becomes a :class:`Model`'s ``ratio``, which is K.
    """
    a, c, g, t = np.moveaxis(np.asarray(frequencies, float), -1, 0)
    purine, pyrimidine = a + g, c + t
    return np.maximum(0.0, (ratio * purine * pyrimidine - a * g - c * t) / (a * g / purine + c * t / pyrimidine))


@dataclass(frozen=True)
class Model:
    """F84 with ``ratio`` as the excess of transitions (:func:`excess`; 0: none, which with equal frequencies is JC69), scaled to one change per unit."""

    frequencies: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)
    ratio: float = 0.0
    rates: tuple[float, ...] = (1.0,)

    def transition(self, t: float) -> np.ndarray:
        pi = np.array(self.frequencies)
        group = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [1, 0, 1, 0], [0, 1, 0, 1]], float)
        within = group * pi[None, :] / (group @ pi)[:, None]
        q = pi[None, :] + self.ratio * within
        speed = sum(pi[i] * q[i, j] for i in range(4) for j in range(4) if i != j)
        none, ts_only = math.exp(-(1 + self.ratio) * t / speed), math.exp(-t / speed)
        return none * np.eye(4) + (ts_only - none) * within + (1 - ts_only) * pi[None, :].repeat(4, 0)


@dataclass
class Data:
    """Distinct columns and their weights: ``tips[name]`` has a row of four likelihoods per column."""

    tips: dict[str, np.ndarray]
    weights: np.ndarray
    pattern_of_site: np.ndarray = field(default_factory=lambda: np.empty(0, int))

    @staticmethod
    def of(sequences: dict[str, np.ndarray]) -> Data:
        """``sequences``: a 4-bit mask per site (15: unknown) for each name."""
        names = sorted(sequences)
        columns, inverse, counts = np.unique(np.stack([sequences[n] for n in names]), axis=1, return_inverse=True, return_counts=True)
        bits = (columns[:, :, None] >> np.arange(4)) & 1
        return Data({n: bits[k].astype(float) for k, n in enumerate(names)}, counts.astype(float), inverse)


def pattern_lnl(root: Node, data: Data, model: Model) -> np.ndarray:
    """Log-likelihood of each column; the mean over the model's rates."""
    pi, per_rate = np.array(model.frequencies), []
    for rate in model.rates:
        state: dict[Node, np.ndarray] = {}
        scale = np.zeros(len(data.weights))
        for node in root.postorder():
            if node.is_leaf:
                own = data.tips[node.name]
            else:
                own = np.ones((len(data.weights), 4))
                for child in node.children:
                    own = own * state.pop(child)
                top = own.max(1)
                small = top < 1e-100
                if small.any():
                    factor = np.where(small, np.maximum(top, 1e-300), 1.0)
                    own, scale = own / factor[:, None], scale + np.log(factor)
            if node is root:
                with np.errstate(divide="ignore"):
                    per_rate.append(np.log(own @ pi) + scale)
            else:
                length = 0.1 if node.length is None else max(node.length, LOW)
                state[node] = own @ model.transition(rate * length).T
    stack = np.stack(per_rate)
    top = stack.max(0)
    return top + np.log(np.exp(stack - top).mean(0))


def lnl(root: Node, data: Data, model: Model) -> float:
    return float(pattern_lnl(root, data, model) @ data.weights)


def golden(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-4, steps: int = 60) -> tuple[float, float]:
    """The place and value of the maximum of a unimodal function."""
    phi = (math.sqrt(5) - 1) / 2
    a, b = high - phi * (high - low), low + phi * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if high - low < tolerance:
            break
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + phi * (high - low)
            fb = f(b)
        else:
            high, b, fb = b, a, fa
            a = high - phi * (high - low)
            fa = f(a)
    return (a, fa) if fa >= fb else (b, fb)


def optimize_lengths(root: Node, data: Data, model: Model, rounds: int = 20, tolerance: float = 1e-4) -> float:
    """Branch by branch on a log scale, as long as a round gains; returns the log-likelihood, which never falls."""
    best = lnl(root, data, model)
    for _ in range(rounds):
        before = best
        for node in [n for n in root.postorder() if n is not root]:
            kept = node.length if node.length is not None else 0.1

            def at(x: float, node: Node = node) -> float:
                node.length = math.exp(x)
                return lnl(root, data, model)

            center = math.log(max(kept, 1e-6))
            x, value = golden(at, max(math.log(LOW), center - 3), min(math.log(HIGH), center + 3), 1e-3, 24)
            if value > best:
                best, node.length = value, math.exp(x)
            else:
                node.length = kept
        if best - before < tolerance:
            break
    return best


def nni(tree: Node):
    """The two neighbours across each inner branch."""
    for node in list(tree.preorder()):
        for k, inner in enumerate(node.children):
            others = [m for m in range(len(node.children)) if m != k]
            for other in others[:1]:
                for j in range(min(2, len(inner.children))):
                    node.children[other], inner.children[j] = inner.children[j], node.children[other]
                    yield tree
                    node.children[other], inner.children[j] = inner.children[j], node.children[other]


def climb(tree: Node, data: Data, model: Model, moves, rounds: int = 100) -> tuple[Node, float]:
    """Of a round's moves, scored as they are, the best is optimised and taken if it gains."""
    best = optimize_lengths(tree, data, model)
    for _ in range(rounds):
        top, found = -math.inf, None
        for trial in moves(tree):
            if (value := lnl(trial, data, model)) > top:
                top, found = value, trial.copy()
        if found is None:
            break
        value = optimize_lengths(found, data, model)
        if value <= best + 1e-4:
            break
        tree, best = found, value
    return tree, best


def ml_search(names: list[str], data: Data, model: Model, moves=regrafts) -> tuple[Node, float]:
    """Stepwise addition by likelihood, then a climb by regrafts (or ``nni``)."""
    tree = Node(children=[Node(n, 0.1) for n in names[:3]])
    for name in names[3:]:
        top, found = -math.inf, None
        for trial in _placed(tree, Node(name, 0.1)):
            if (value := lnl(trial, data, model)) > top:
                top, found = value, trial.copy()
        tree = found
        optimize_lengths(tree, data, model, rounds=2)
    return climb(tree, data, model, moves)


def pair_distance(counts: np.ndarray, model: Model) -> float:
    """The most likely distance of two sequences with 4 x 4 counts of states: 0 if all agree, 10 without a maximum below."""
    if counts.sum() == np.trace(counts):
        return 0.0
    x, _ = golden(lambda x: float((counts * np.log(np.maximum(model.transition(math.exp(x)), 1e-300))).sum()), math.log(LOW), math.log(HIGH), 1e-8, 120)
    return HIGH if math.exp(x) > 0.999 * HIGH else math.exp(x)


def gamma_shape(root: Node, data: Data, model: Model, categories: int = 4) -> tuple[float, float]:
    """The most likely shape of gamma-distributed rates within 0.01 and 100; and the log-likelihood."""
    from .stats import gamma_rates

    def at(x: float) -> float:
        return lnl(root, data, Model(model.frequencies, model.ratio, tuple(gamma_rates(math.exp(x), categories))))

    x, value = golden(at, math.log(0.01), math.log(100), 1e-3)
    return math.exp(x), value


def select_model(tree: Node, data: Data, models: dict[str, tuple[Model, int]]) -> list[dict]:
    """Each model's optimised likelihood with AIC, AICc, BIC and Akaike weight, best AIC first."""
    n, out = data.weights.sum(), []
    for name, (model, extra) in models.items():
        own = tree.copy()
        value = optimize_lengths(own, data, model)
        k = extra + min(sum(1 for _ in own.preorder()) - 1, 2 * len(own.leaves()) - 3)
        aic = 2 * k - 2 * value
        out.append({"model": name, "lnl": value, "k": k, "aic": aic, "aicc": aic + 2 * k * (k + 1) / max(n - k - 1, 1), "bic": k * math.log(n) - 2 * value})
    low = min(r["aic"] for r in out)
    total = sum(math.exp((low - r["aic"]) / 2) for r in out)
    return sorted(({**r, "weight": math.exp((low - r["aic"]) / 2) / total} for r in out), key=lambda r: r["aic"])


def simulate(root: Node, n_sites: int, model: Model, seed: int, part: tuple[int, int] | None = None) -> dict[str, np.ndarray]:
    """Sequences as masks, evolved from the root's equilibrium down the tree; or the sites of a ``part`` (first, end) of them, without the others."""
    first, end = part or (0, n_sites)

    def draws(node: int) -> np.ndarray:
        bits = np.random.PCG64(seed)
        bits.advance(node * n_sites + first)
        return np.random.Generator(bits).random(end - first)

    shares = np.cumsum(model.frequencies)
    state = {root: np.searchsorted(shares / shares[-1], draws(0), side="right")}
    out = {}
    for node in root.preorder():
        if node.is_leaf:
            out[node.name] = 1 << state[node]
        for child in node.children:
            table = model.transition(0.1 if child.length is None else max(child.length, LOW)).cumsum(1)
            state[child] = np.minimum((draws(len(state))[:, None] > table[state[node]]).sum(1), 3)
    return out
