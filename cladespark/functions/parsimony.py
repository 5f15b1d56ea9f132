"""Parsimony searches over small trees in NumPy: all sites of a tree are scored at once by bit masks."""

from __future__ import annotations

import numpy as np

from .newick import Node


def score(root: Node, masks: dict[str, np.ndarray], weights: np.ndarray | None = None) -> int:
    """Fitch steps; nodes with more than two children are folded in order."""
    state: dict[Node, np.ndarray] = {}
    steps = 0
    for node in root.postorder():
        if node.is_leaf:
            state[node] = masks[node.name]
            continue
        own = state.pop(node.children[0])
        for child in node.children[1:]:
            other = state.pop(child)
            both = own & other
            miss = both == 0
            steps += int(miss.sum() if weights is None else weights[miss].sum())
            own = np.where(miss, own | other, both)
        state[node] = own
    return steps


def _placed(tree: Node, tip: Node):
    """Every tree that has ``tip`` on a branch of ``tree``; the tree is put back after each."""
    for node in list(tree.preorder()):
        for k, child in enumerate(list(node.children)):
            node.children[k] = Node(children=[child, tip])
            yield tree
            node.children[k] = child


def stepwise(names: list[str], masks: dict[str, np.ndarray], weights=None) -> Node:
    """Add taxa in order, each where the tree stays shortest (ties: the first place)."""
    tree = Node(children=[Node(n) for n in names[:3]])
    for name in names[3:]:
        best, found = None, None
        for trial in _placed(tree, Node(name)):
            length = score(trial, masks, weights)
            if best is None or length < best:
                best, found = length, trial.copy()
        tree = found
    return tree


def regrafts(tree: Node):
    """Trees that result from cutting one subtree and putting it on another branch."""
    for cut in [n for n in tree.preorder() if n is not tree]:
        marks = list(tree.preorder())
        base = tree.copy()
        twin = list(base.preorder())[marks.index(cut)]
        parent = base.parents()[twin]
        parent.children.remove(twin)
        up = base.parents().get(parent)
        if len(parent.children) == 1 and up is not None:
            up.children[up.children.index(parent)] = parent.children[0]
        elif len(base.children) == 2 and any(c.children for c in base.children):
            inner = next(c for c in base.children if c.children)
            base.children.remove(inner)
            base.children.extend(inner.children)
        if len(base.leaves()) >= 2:
            yield from _placed(base, twin)


def search(names: list[str], masks: dict[str, np.ndarray], weights=None) -> tuple[Node, int]:
    """Stepwise addition, then the best regraft as long as one is shorter."""
    if len(names) < 4:
        tree = Node(children=[Node(n) for n in names])
        return tree, score(tree, masks, weights)
    tree = stepwise(names, masks, weights)
    length = score(tree, masks, weights)
    while True:
        best, found = length, None
        for trial in regrafts(tree):
            if (own := score(trial, masks, weights)) < best:
                best, found = own, trial.copy()
        if found is None:
            return tree, length
        tree, length = found, best


def branch_and_bound(names: list[str], masks: dict[str, np.ndarray], weights=None, max_trees: int = 100) -> tuple[list[Node], int]:
    """All shortest trees (at most ``max_trees`` are kept). A partial tree longer than the best known is given up."""
    bound = search(names, masks, weights)[1]
    found: list[Node] = []

    def grow(tree: Node, k: int) -> None:
        nonlocal bound, found
        length = score(tree, masks, weights)
        if length > bound:
            return
        if k == len(names):
            if length < bound:
                bound, found = length, []
            if len(found) < max_trees:
                found.append(tree.copy())
            return
        for trial in _placed(tree, Node(names[k])):
            grow(trial.copy(), k + 1)

    grow(Node(children=[Node(n) for n in names[:3]]), min(3, len(names)))
    return found, bound


def maximum_clique(neighbors: list[int]) -> tuple[list[int], int]:
    """A largest clique of a graph given by bit masks, the first one met, and the number of maximal cliques (pivoted search)."""
    best: list[int] = []
    count = 0
    stack = [(0, (1 << len(neighbors)) - 1, 0)]
    while stack:
        own, open_, closed = stack.pop()
        if not open_ and not closed:
            count += 1
            if own.bit_count() > len(best):
                best = [k for k in range(len(neighbors)) if own >> k & 1]
            continue
        both = open_ | closed
        pivot = max((k for k in range(len(neighbors)) if both >> k & 1), key=lambda k: (neighbors[k] & open_).bit_count())
        later, rest = [], open_ & ~neighbors[pivot]
        for k in range(len(neighbors)):
            if rest >> k & 1:
                later.append((own | 1 << k, open_ & neighbors[k], closed & neighbors[k]))
                open_ &= ~(1 << k)
                closed |= 1 << k
        stack.extend(reversed(later))
    return best, count
