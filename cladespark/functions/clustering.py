"""Trees from distance matrices, one matrix per group of rows, in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import workers_see_package
from .newick import Node, write


def neighbor_joining(names: list[str], d: np.ndarray) -> Node:
    """Join the pair with the least (m - 2) d - r - r until three are left; ties go to the first pair. At least three taxa."""
    d = np.array(d, float)
    nodes = [Node(n) for n in names]
    live = list(range(len(names)))
    while len(live) > 3:
        m = len(live)
        sub = d[np.ix_(live, live)]
        r = sub.sum(1)
        q = (m - 2) * sub - r[:, None] - r[None, :]
        q[np.tril_indices(m)] = np.inf
        a, b = divmod(int(q.argmin()), m)
        half, lean = sub[a, b] / 2, (r[a] - r[b]) / (2 * (m - 2))
        i, j = live[a], live[b]
        nodes[i].length, nodes[j].length = half + lean, half - lean
        merged = (d[i] + d[j] - d[i, j]) / 2
        d[i], d[:, i] = merged, merged
        d[i, i] = 0
        nodes[i] = Node(children=[nodes[i], nodes[j]])
        live.remove(j)
    if len(live) == 3:
        x, y, z = live
        for i, j, k in ((x, y, z), (y, x, z), (z, x, y)):
            nodes[i].length = (d[i, j] + d[i, k] - d[j, k]) / 2
    elif len(live) == 2:
        for i in live:
            nodes[i].length = d[live[0], live[1]] / 2
    return Node(children=[nodes[i] for i in live])


def upgma(names: list[str], d: np.ndarray) -> Node:
    """Average linkage; a node's height is half the distance of its children. Ties go to the first pair."""
    d = np.array(d, float)
    n = len(names)
    nodes, size, high = [Node(x) for x in names], np.ones(n), np.zeros(n)
    live = list(range(n))
    np.fill_diagonal(d, np.inf)
    while len(live) > 1:
        sub = d[np.ix_(live, live)].copy()
        sub[np.tril_indices(len(live))] = np.inf
        a, b = divmod(int(sub.argmin()), len(live))
        i, j = live[a], live[b]
        height = d[i, j] / 2
        nodes[i].length, nodes[j].length = height - high[i], height - high[j]
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        nodes[i] = Node(children=[nodes[i], nodes[j]])
        size[i] += size[j]
        high[i] = height
        live.remove(j)
    return nodes[live[0]]


def _paths(root: Node, names: list[str]) -> tuple[np.ndarray, list[Node]]:
    """For each pair of taxa (i < j), which branches lie between them; and the branches."""
    place = {n: k for k, n in enumerate(names)}
    branches = [n for n in root.postorder() if n is not root]
    below: dict[Node, np.ndarray] = {}
    for node in root.postorder():
        below[node] = np.zeros(len(names), bool)
        if node.is_leaf:
            below[node][place[node.name]] = True
        for c in node.children:
            below[node] |= below[c]
    i, j = np.triu_indices(len(names), 1)
    return np.stack([below[b][i] != below[b][j] for b in branches], 1).astype(float), branches


def fitch_margoliash(names: list[str], d: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[Node, float]:
    """Branch lengths of at least 0 on the neighbour-joining topology that minimise the sum of ((d - path) / d)^2; and that sum."""
    root = neighbor_joining(names, d)
    x, branches = _paths(root, names)
    goal = np.asarray(d)[np.triu_indices(len(names), 1)]
    weight = np.where(goal > 0, 1 / np.where(goal > 0, goal, 1) ** 2, 0)
    length = np.array([max(0.0, b.length or 0.0) for b in branches])
    rest = goal - x @ length
    scale = (x * weight[:, None] * x).sum(0)
    for _ in range(rounds):
        moved = 0.0
        for k in range(len(branches)):
            if scale[k] > 0:
                new = max(0.0, length[k] + (weight * x[:, k]) @ rest / scale[k])
                rest -= x[:, k] * (new - length[k])
                moved, length[k] = max(moved, abs(new - length[k])), new
        if moved < tolerance:
            break
    for b, n in zip(branches, length, strict=True):
        b.length = float(n)
    return root, float((weight * rest**2).sum())


def kitsch(names: list[str], d: np.ndarray, rounds: int = 200, tolerance: float = 1e-8) -> tuple[Node, float]:
    """Heights of the average-linkage topology that minimise the same sum with all tips at one level; and that sum.

    Each height has a closed-form optimum for the pairs it separates, bounded by its children's and parent's heights."""
    root = upgma(names, d)
    place = {n: k for k, n in enumerate(names)}
    below, height = {}, {}
    for node in root.postorder():
        below[node] = [place[node.name]] if node.is_leaf else [t for c in node.children for t in below[c]]
        height[node] = 0.0 if node.is_leaf else max(height[c] + (c.length or 0) for c in node.children)
    parents, inner = root.parents(), [n for n in root.postorder() if not n.is_leaf]
    d = np.asarray(d, float)
    across = {n: d[np.ix_(below[n.children[0]], below[n.children[1]])].ravel() for n in inner}
    across = {n: g[g > 0] for n, g in across.items()}
    for _ in range(rounds):
        moved = 0.0
        for n in inner:
            goal = across[n]
            best = (1 / goal).sum() / (2 / goal**2).sum() if len(goal) else height[n]
            new = max(best, max(height[c] for c in n.children))
            if n in parents:
                new = min(new, height[parents[n]])
            moved, height[n] = max(moved, abs(new - height[n])), new
        if moved < tolerance:
            break
    for n in inner:
        for c in n.children:
            c.length = height[n] - height[c]
    return root, float(sum((((across[n] - 2 * height[n]) / across[n]) ** 2).sum() for n in inner))


def weighted_squares(root: Node, names: list[str], d: np.ndarray) -> float:
    """What a tree with its lengths leaves of a matrix: the sum of ((d - path) / d)^2 over pairs."""
    x, branches = _paths(root, names)
    goal = np.asarray(d)[np.triu_indices(len(names), 1)]
    rest = goal - x @ np.array([b.length or 0.0 for b in branches])
    return float((np.where(goal > 0, rest / np.where(goal > 0, goal, 1), 0) ** 2).sum())


METHODS = {"nj": neighbor_joining, "upgma": upgma, "fm": lambda n, d: fitch_margoliash(n, d)[0], "kitsch": lambda n, d: kitsch(n, d)[0]}


def matrix(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and the symmetric matrix of rows ``i, j, d``; a pair without a distance gets 10."""
    names = sorted(set(pairs["i"]) | set(pairs["j"]))
    place = {n: k for k, n in enumerate(names)}
    d = np.full((len(names), len(names)), 10.0)
    np.fill_diagonal(d, 0)
    i, j = pairs["i"].map(place).to_numpy(), pairs["j"].map(place).to_numpy()
    d[i, j] = d[j, i] = pairs["d"].fillna(10.0).to_numpy(float)
    return [str(n) for n in names], d


def trees(distances: DataFrame, method: str = "nj", group: str = "aln") -> DataFrame:
    """``aln, newick``: a tree for each group of rows ``aln, i, j, d``. One task holds one group's matrix, which is what a
    kernel works on; groups (alignments, replicates) go to as many tasks as there are."""
    workers_see_package(distances.sparkSession)
    build = METHODS[method]

    def run(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [key[0]], "newick": [write(build(*matrix(pairs)))]})

    kind = dict(distances.dtypes)[group]
    return distances.groupBy(group).applyInPandas(run, f"{group} {kind}, newick string")
