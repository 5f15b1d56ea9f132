"""Trees and their Newick text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..session import workers_see_package

_TOKEN = re.compile(r"\s*(?:([(),;])|:\s*([^\s(),:;\[]+)|'((?:[^']|'')*)'|([^\s(),:;\[']+))")


class NewickError(ValueError):
    """A text that is no Newick tree."""


@dataclass(eq=False)
class Node:
    name: str | None = None
    length: float | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def is_leaf(self) -> bool:
        return not self.children

    def postorder(self) -> Iterator[Node]:
        stack = [(self, False)]
        while stack:
            node, seen = stack.pop()
            if seen or node.is_leaf:
                yield node
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))

    def preorder(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def leaves(self) -> list[Node]:
        return [n for n in self.postorder() if n.is_leaf]

    def copy(self) -> Node:
        made: dict[int, Node] = {}
        for node in self.postorder():
            made[id(node)] = Node(node.name, node.length, [made[id(c)] for c in node.children])
        return made[id(self)]

    def parents(self) -> dict[Node, Node]:
        return {c: n for n in self.preorder() for c in n.children}


def parse(text: str) -> Node:
    """A tree of nested names and ``:length``s that ends with ``;``. An underscore in a name stands for a blank. No comments."""
    root, at, done, fresh = Node(), 0, False, True
    path, current = [], root
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if done or not m:
            raise NewickError(f"unexpected {text[at : at + 12]!r} at {at}")
        at = m.end()
        sign, length, quoted, bare = m.groups()
        if sign == "(":
            if not fresh:
                raise NewickError(f"unexpected '(' at {at}")
            path.append(current)
            current.children.append(Node())
            current = current.children[-1]
        elif sign == ",":
            if not path:
                raise NewickError("a comma outside of parentheses")
            path[-1].children.append(Node())
            current, fresh = path[-1].children[-1], True
        elif sign == ")":
            if not path:
                raise NewickError("an unopened parenthesis")
            current, fresh = path.pop(), False
        elif sign == ";":
            done = True
        elif length is not None:
            try:
                current.length = float(length)
            except ValueError:
                raise NewickError(f"no number: {length!r}") from None
            fresh = False
        else:
            current.name = quoted.replace("''", "'") if quoted is not None else bare.replace("_", " ")
            fresh = False
    if path or not done:
        raise NewickError("the tree isn't closed" if path else "no ';' at the end")
    return root


def write(root: Node) -> str:
    """Newick text; lengths have at most ten decimals."""
    text: dict[int, str] = {}
    for node in root.postorder():
        inner = f"({','.join(text.pop(id(c)) for c in node.children)})" if node.children else ""
        length = "" if node.length is None else ":" + (f"{node.length:.10f}".rstrip("0").rstrip(".") or "0")
        text[id(node)] = inner + (node.name or "").replace(" ", "_") + length
    return text[id(root)] + ";"


def split_sets(root: Node) -> dict[frozenset[str], float]:
    """Non-trivial splits as the side without the least name, with the lengths of their branches."""
    names = sorted(n.name or "" for n in root.leaves())
    below: dict[int, frozenset[str]] = {}
    out: dict[frozenset[str], float] = {}
    for node in root.postorder():
        below[id(node)] = frozenset([node.name or ""]) if node.is_leaf else frozenset().union(*(below[id(c)] for c in node.children))
        side = below[id(node)] if names[0] not in below[id(node)] else frozenset(names) - below[id(node)]
        if node is not root and 1 < len(side) < len(names) - 1:
            out[side] = out.get(side, 0.0) + (node.length or 0.0)
    return out


def robinson_foulds(a: Node, b: Node) -> int:
    return len(split_sets(a).keys() ^ split_sets(b).keys())


NODES = "array<struct<id:int,parent:int,ord:int,name:string,bl:double,level:int>>"


def newick_nodes(text: str | None) -> list[tuple] | None:
    """Rows of a tree's nodes in preorder; null for a null or malformed text."""
    if text is None:
        return None
    try:
        root = parse(text)
    except NewickError:
        return None
    ids = {n: k for k, n in enumerate(root.preorder())}
    parents, level = root.parents(), {root: 0}
    rows = []
    for node, k in ids.items():
        up = parents.get(node)
        if up is not None:
            level[node] = level[up] + 1
        rows.append((k, ids[up] if up else None, up.children.index(node) if up else 0, node.name, node.length, level[node]))
    return rows


def explode_trees(trees: DataFrame, id_col: str = "tree", text_col: str = "newick") -> DataFrame:
    """``tree, id, parent, ord, name, bl, level``: the nodes of every readable tree."""
    workers_see_package(trees.sparkSession)
    nodes = F.udf(newick_nodes, NODES)
    return trees.select(id_col, F.explode(nodes(text_col)).alias("n")).select(id_col, "n.*")


@udtf(returnType="id int, parent int, ord int, name string, bl double, level int")
class NewickNodes:
    """The nodes of a tree in preorder, for ``LATERAL``; none for a null or malformed text."""

    def eval(self, text: str):
        yield from newick_nodes(text) or []


def register(spark: SparkSession) -> None:
    """Add the table function ``newick_nodes(text)`` to SQL."""
    workers_see_package(spark)
    spark.udtf.register("newick_nodes", NewickNodes)


def lateral_trees(trees: DataFrame, id_col: str = "tree", text_col: str = "newick") -> DataFrame:
    """As :func:`explode_trees`, by a lateral join in SQL."""
    register(trees.sparkSession)
    return trees.sparkSession.sql(f"SELECT t.`{id_col}`, n.* FROM {{trees}} t, LATERAL newick_nodes(t.`{text_col}`) n", trees=trees)
