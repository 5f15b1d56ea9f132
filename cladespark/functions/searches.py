"""Tree searches under any parsimony score, in NumPy: a score is a function of a tree, over all character columns at once.

``hill_climb`` scores whole trees, so it takes any score. ``step_matrix_moves`` takes any symmetric matrix of steps between states: it asks for the costs of moves, which are sums over
columns, so blocks of columns can be scored apart; ``StepCosts`` keeps the costs of every directed branch, so a regraft costs one addition of arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np

from .newick import Node
from .parsimony import _placed, regrafts

Score = Callable[[Node], float]
FAR = 1 << 13  #: more than any path through a matrix of steps


def _places(tree: Node, tip: Node, rooted: bool) -> Iterator[Node]:
    yield from _placed(tree, tip)
    if rooted:
        yield Node(children=[tree, tip])


def hill_climb(names: list[str], score: Score, rooted: bool = False) -> tuple[Node, float]:
    """Taxa are added in order where the tree scores least, then the best regraft is taken as long as one gains (ties: the first)."""
    if len(names) < 3:
        tree = Node(children=[Node(n) for n in names])
        return tree, score(tree)
    tree = Node(children=[Node(n) for n in names[:2]]) if rooted else Node(children=[Node(n) for n in names[:3]])
    for name in names[len(tree.children) :]:
        _, _, tree = min(((score(t), k, t.copy()) for k, t in enumerate(_places(tree, Node(name), rooted))), key=lambda x: x[:2])
    best = score(tree)
    while True:
        found = None
        for trial in regrafts(tree):
            if len(trial.leaves()) == len(names) and (own := score(trial)) < best:
                best, found = own, trial.copy()
        if found is None:
            return tree, best
        tree = found


def fitch_steps(root: Node, masks: dict[str, np.ndarray]) -> np.ndarray:
    """Unordered steps of each column; ``masks`` hold up to 32 states, all bits for a missing one."""
    state: dict[Node, np.ndarray] = {}
    steps = np.zeros(len(next(iter(masks.values()))), np.int64)
    for node in root.postorder():
        if node.is_leaf:
            state[node] = masks[node.name]
            continue
        own = state.pop(node.children[0])
        for child in node.children[1:]:
            other = state.pop(child)
            both = own & other
            miss = both == 0
            steps += miss
            own = np.where(miss, own | other, both)
        state[node] = own
    return steps


def compatible_columns(root: Node, masks: dict[str, np.ndarray]) -> np.ndarray:
    """Which columns need one step less than they have states (missing ones, all bits set, don't count)."""
    stack = np.stack(list(masks.values()))
    missing = np.bitwise_or.reduce(stack, axis=0)
    single = (stack & (stack - 1)) == 0
    seen = np.bitwise_or.reduce(np.where(single, stack, 0), axis=0)
    states = np.array([int(x).bit_count() for x in seen])
    return (fitch_steps(root, masks) <= np.maximum(states - 1, 0)) & (missing > 0)


def camin_sokal_steps(root: Node, states: dict[str, np.ndarray]) -> np.ndarray:
    """Irreversible changes 0 to 1 of each column; the root is 0."""
    below: dict[Node, np.ndarray] = {}
    steps = np.zeros(len(next(iter(states.values()))), np.int64)
    for node in root.postorder():
        if node.is_leaf:
            below[node] = states[node.name]
            continue
        own = np.stack([below.pop(c) for c in node.children])
        low = own.min(0)
        steps += np.where(low == 1, 0, own.sum(0))
        below[node] = low
    return steps + below[root]


def dollo_steps(root: Node, states: dict[str, np.ndarray]) -> np.ndarray:
    """One gain, at the least common ancestor of all tips with state 1, and the losses below it."""
    total = np.sum(list(states.values()), axis=0)
    ones: dict[Node, np.ndarray] = {}
    losses: dict[Node, np.ndarray] = {}
    done = np.zeros_like(total)
    out = np.zeros(len(total), np.int64)
    for node in root.postorder():
        if node.is_leaf:
            ones[node], losses[node] = states[node.name].astype(np.int64), np.zeros(len(total), np.int64)
        else:
            n = sum(ones[c] for c in node.children)
            losses[node] = sum(np.where(ones[c] == 0, 1, losses[c]) for c in node.children)
            ones[node] = n
        here = (ones[node] == total) & (total > 0) & (done == 0)
        out, done = np.where(here, 1 + losses[node], out), np.where(here, 1, done)
    return out


def _cheapest(cost: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Least cost of each state at the other end of a branch: a min-plus product."""
    out = cost[:, :1] + steps[:, 0]
    for k in range(1, cost.shape[1]):
        np.minimum(out, cost[:, k : k + 1] + steps[:, k], out=out)
    return out


def leaf_costs(masks: np.ndarray, n_states: int) -> np.ndarray:
    """0 for the states in a mask, ``FAR`` for others."""
    return np.where((masks[:, None] >> np.arange(n_states)) & 1, 0, FAR).astype(np.int16)


def sankoff_costs(root: Node, leaves: dict[str, np.ndarray], steps: np.ndarray) -> np.ndarray:
    """Least steps of each column; ``leaves``: rows of state costs by taxon; ``steps[s, r]``: steps from state s to r, any matrix."""
    own: dict[Node, np.ndarray] = {}
    for node in root.postorder():
        own[node] = leaves[node.name].astype(np.int64) if node.is_leaf else sum(_cheapest(own.pop(c), steps.astype(np.int64)) for c in node.children)
    return own[root].min(1)


Near = dict[int, list[int]]  #: an unrooted tree: the neighbours of each node; tips have the least numbers
Question = tuple[Near, int | None]  #: a tree, and the tip that goes to each of its branches; without one, each of its parts goes to each other branch


def _link(near: Near, a: int, b: int) -> None:
    near.setdefault(a, []).append(b)
    near.setdefault(b, []).append(a)


def _unlink(near: Near, a: int, b: int) -> None:
    near[a].remove(b)
    near[b].remove(a)


def _insert(near: Near, a: int, b: int, top: int, joint: int) -> None:
    _unlink(near, a, b)
    for end in (a, b, top):
        _link(near, joint, end)


def _branches(near: Near) -> list[tuple[int, int]]:
    return [(a, b) for a in sorted(near) for b in near[a] if a < b]


def _prunings(near: Near, n: int) -> Iterator[tuple[int, int, int, int, Near, list[tuple[int, int]]]]:
    """``joint, top, a, b``: the part that hangs from ``joint`` at ``top`` is cut off, and the branch it hung on is from ``a`` to ``b``; what is left, and the branches to try."""
    for joint, top in [(x, y) for x in sorted(near) if x >= n for y in near[x]]:
        left = {k: list(v) for k, v in near.items()}
        a, b = (z for z in near[joint] if z != top)
        for end in (top, a, b):
            _unlink(left, joint, end)
        _link(left, a, b)
        del left[joint]
        stack = [top]
        while stack:
            stack += left.pop(stack.pop(), [])
        if len(left) > 2:
            yield joint, top, a, b, left, [place for place in _branches(left) if place != (min(a, b), max(a, b))]


def as_node(near: Near, names: list[str]) -> Node:
    start = near[0][0]
    made: dict[int, Node] = {}
    order, stack = [], [(start, -1)]
    while stack:
        x, up = stack.pop()
        order.append((x, up))
        stack += [(z, x) for z in sorted(near[x], reverse=True) if z != up]
    for x, up in reversed(order):
        made[x] = Node(names[x]) if x < len(names) else Node(children=[made[z] for z in sorted(near[x]) if z != up])
    return made[start]


class StepCosts:
    """Costs of trees over some columns. ``tips``: what the branch of each tip sends to its other end, rows of costs by state."""

    def __init__(self, tips: list[np.ndarray], steps: np.ndarray) -> None:
        self.tips = tips
        self.steps = steps.astype(tips[0].dtype)[:, :, None]

    def _cheapest(self, cost: np.ndarray) -> np.ndarray:
        return (self.steps + cost).min(1)

    def _send(self, x: int, below: list[np.ndarray]) -> np.ndarray:
        return self.tips[x] if x < len(self.tips) else self._cheapest(sum(below[1:], below[0]))

    def _sent(self, near: Near) -> dict[tuple[int, int], np.ndarray]:
        """What each end of a branch sends to the other."""
        order, stack = [], [(min(near), -1)]
        while stack:
            x, up = stack.pop()
            order.append((x, up))
            stack += [(z, x) for z in near[x] if z != up]
        sent: dict[tuple[int, int], np.ndarray] = {}
        for x, up in reversed(order[1:]):
            sent[x, up] = self._send(x, [sent[z, x] for z in near[x] if z != up])
        for x, up in order:
            for z in near[x]:
                if z != up:
                    sent[x, z] = self._send(x, [sent[w, x] for w in near[x] if w != z])
        return sent

    def __call__(self, question: Question, weights: np.ndarray) -> np.ndarray:
        """The cost of each answer."""
        near, tip = question
        total = lambda *parts: int(sum(parts[1:], parts[0]).min(0).astype(np.int64) @ weights)
        if tip is None and len(self.tips) < 4:
            return np.array([total(*self.tips)])
        sent = self._sent(near)
        if tip is not None:
            return np.array([total(sent[a, b], sent[b, a], self.tips[tip]) for a, b in _branches(near)])
        found = []
        for joint, top, a, b, left, places in _prunings(near, len(self.tips)):
            fresh = {(a, b): sent[a, joint], (b, a): sent[b, joint]}  # only what is sent away from the cut changes
            at = lambda x, y, fresh=fresh: fresh[x, y] if (x, y) in fresh else sent[x, y]
            stack = [(a, b), (b, a)]
            while stack:
                x, up = stack.pop()
                for z in left[x]:
                    if z != up:
                        fresh[x, z] = self._send(x, [at(w, x) for w in left[x] if w != z])
                        stack.append((z, x))
            found += [total(at(x, y), at(y, x), sent[top, joint]) for x, y in places]
        return np.array(found, np.int64)


def cost_type(n: int, steps: np.ndarray) -> type:
    """The least type that holds all costs of trees with ``n`` tips."""
    most = 2 * n * int(steps.max())
    return np.uint8 if most < 1 << 8 else np.int16 if most < 1 << 15 else np.int64


def step_matrix_moves(n: int) -> Generator[Question, tuple[int, int], tuple[Near, int]]:
    """Stepwise addition, then the best of all regrafts as long as one gains: the tree and its steps. Each question is answered by the place of the first of the least costs, and that cost."""
    near: Near = {}
    for k in range(min(n, 3)):
        _link(near, n, k)
    if n < 4:
        return near, (yield near, None)[1]
    length, fresh = 0, n + 1
    for k in range(3, n):
        at, length = yield near, k
        _insert(near, *_branches(near)[at], k, fresh)
        fresh += 1
    while True:
        at, cost = yield near, None
        if cost >= length:
            return near, length
        for joint, top, a, b, _, places in _prunings(near, n):
            if at < len(places):
                break
            at -= len(places)
        for end in (top, a, b):
            _unlink(near, joint, end)
        del near[joint]
        _link(near, a, b)
        _insert(near, *places[at], top, fresh)
        length, fresh = cost, fresh + 1


def step_matrix_search(names: list[str], leaves: dict[str, np.ndarray], steps: np.ndarray, weights: np.ndarray | None = None) -> tuple[Node, int]:
    """A tree and its steps, from all columns at once. ``steps`` must be symmetric."""
    kind = cost_type(len(names), steps)
    costs = StepCosts([np.ascontiguousarray(_cheapest(leaves[n].astype(np.int64), steps.astype(np.int64)).T.astype(kind)) for n in names], steps)
    weights = np.ones(len(leaves[names[0]]), np.int64) if weights is None else weights.astype(np.int64)
    moves = step_matrix_moves(len(names))
    question = next(moves)
    while True:
        found = costs(question, weights)
        try:
            question = moves.send((int(found.argmin()), int(found.min())))
        except StopIteration as done:
            near, length = done.value
            return as_node(near, names), length


def tree_of_splits(splits: list[int], names: list[str], label: Callable[[int], str | None] = lambda _: None, length: Callable[[int], float | None] = lambda _: None) -> Node:
    """The tree of compatible splits, masks without taxon 0: smaller ones first, and one that fits none of the nodes made so far is left out."""
    root = Node()
    under = {root: (1 << len(names)) - 1}
    made: dict[int, Node] = {}
    for k, name in enumerate(names):
        made[1 << k] = Node(name, length(1 << k))
    roots = list(made.items())
    for mask in sorted(set(splits), key=lambda m: (m.bit_count(), m)):
        inside = [(m, n) for m, n in roots if m & mask == m]
        if sum(m.bit_count() for m, _ in inside) != mask.bit_count() or len(inside) < 2:
            continue
        node = Node(label(mask), length(mask), [n for _, n in inside])
        roots = sorted([(m, n) for m, n in roots if m & mask != m] + [(mask, node)], key=lambda r: (r[0] & -r[0], r[0]))
    root.children = [n for _, n in roots]
    del under
    return root
