"""Minimum-cost area histories and host-parasite reconciliation."""

from __future__ import annotations

from collections import Counter
from functools import cache

from .newick import Node


def area_histories(root: Node, areas: dict[str, int], n_areas: int, dispersal: float = 1, extinction: float = 1, max_areas: int | None = None) -> tuple[float, dict[Node, list[int]]]:
    """Least total cost, and each inner node's distributions (area bit masks) of least cost for the clade below it.

    A parent's distribution passes to its two children either divided into disjoint parts or whole to both. Along a branch each area
    gained costs ``dispersal`` and each lost ``extinction``. Tips have their observed distributions.
    """
    full = 1 << n_areas
    allowed = [m for m in range(1, full) if max_areas is None or m.bit_count() <= max_areas]
    change = lambda a, b: dispersal * (b & ~a).bit_count() + extinction * (a & ~b).bit_count()
    cost: dict[Node, dict[int, float]] = {}
    best: dict[Node, list[int]] = {}
    for node in root.postorder():
        if node.is_leaf:
            cost[node] = {areas[node.name]: 0.0}
            continue
        if len(node.children) != 2:
            raise ValueError("area histories need a binary tree")
        arrive = [{s: min(c + change(s, t) for t, c in cost[child].items()) for s in range(1, full)} for child in node.children]
        own = {}
        for m in allowed:
            options = [arrive[0][m] + arrive[1][m]]
            part = (m - 1) & m
            while part:
                options.append(arrive[0][part] + arrive[1][m & ~part])
                part = (part - 1) & m
            own[m] = min(options)
        cost[node] = own
        low = min(own.values())
        best[node] = [m for m, c in own.items() if c == low]
    return min(cost[root].values()), best


def reconcile(host: Node, parasite: Node, hosts: dict[str, str], costs: dict[str, float] | None = None) -> tuple[Counter, float]:
    """Counts of cospeciations, duplications and sortings when each parasite maps to the least common ancestor of its hosts; and their cost.

    A parasite node duplicates if a child maps to the same host; otherwise its children's hosts part below it. Every host node that a
    lineage passes without a split is a sorting. Host switches aren't inferred.
    """
    up = host.parents()
    tips = {n.name: n for n in host.leaves()}

    @cache
    def path(node: Node) -> tuple[Node, ...]:
        return (node, *(path(up[node]) if node in up else ()))

    def common(a: Node, b: Node) -> Node:
        above = set(path(a))
        return next(n for n in path(b) if n in above)

    where: dict[Node, Node] = {}
    events: Counter = Counter(cospeciation=0, duplication=0, sorting=0, switch=0)
    for node in parasite.postorder():
        if node.is_leaf:
            where[node] = tips[hosts[node.name]]
            continue
        at = where[node.children[0]]
        for c in node.children[1:]:
            at = common(at, where[c])
        where[node] = at
        twice = any(where[c] is at for c in node.children)
        events["duplication" if twice else "cospeciation"] += 1
        for c in node.children:
            passed = len(path(where[c])) - len(path(at))
            events["sorting"] += max(0, passed if twice else passed - 1)
    price = {"cospeciation": 0.0, "duplication": 1.0, "sorting": 1.0, "switch": 2.0} | (costs or {})
    return events, sum(price[k] * n for k, n in events.items())
