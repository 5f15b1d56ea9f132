"""What filters do to each other: a count-weighted decision diagram of failure masks per part, read in every order of the filters.

Each document fails a subset of the filters. Spark counts documents by part and subset, which leaves at most 32 rows a part whatever its size.
A part's diagram has the filters as variables, level by level; a leaf is the counts of one subset, and a node's weight is the sum of its leaves.
Exchanging two adjacent levels turns the diagram of one order into that of the next, and a walk over all orders by adjacent exchanges makes each order once. The path on which every filter passes has the steps:
what it leaves at a node on the failing side is removed there, what stays is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import forget, new_path, prepare, small_side, stored

FILTERS = "ABCDE"
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

Weight = tuple[int, ...]


class Diagram:
    """A reduced ordered diagram over subsets of ``n`` variables; equal nodes of one level exist once."""

    def __init__(self, order: list[int], leaves: dict[int, Weight], width: int):
        self.order, self.nothing = list(order), (0,) * width
        self.weights: list[Weight] = []
        self.children: list[tuple[int, int] | None] = []
        self.known: dict[tuple, int] = {}
        self.root = self._grow(leaves, 0, 0)

    def _leaf(self, weight: Weight) -> int:
        return self._node((weight,), weight, None)

    def _inner(self, level: int, low: int, high: int) -> int:
        total = tuple(a + b for a, b in zip(self.weights[low], self.weights[high], strict=True))
        return self._node((self.order[level], low, high), total, (low, high))

    def _node(self, key: tuple, weight: Weight, children: tuple[int, int] | None) -> int:
        if key not in self.known:
            self.known[key] = len(self.weights)
            self.weights.append(weight)
            self.children.append(children)
        return self.known[key]

    def _grow(self, leaves: dict[int, Weight], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(leaves.get(mask, self.nothing))
        low = self._grow(leaves, level + 1, mask)
        return self._inner(level, low, self._grow(leaves, level + 1, mask | 1 << self.order[level]))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next; nodes below stay as they are, those above are made anew."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        made: dict[tuple[int, int], int] = {}

        def moved(node: int, depth: int) -> int:
            if (node, depth) not in made:
                low, high = self.children[node]
                if depth < level:
                    made[node, depth] = self._inner(depth, moved(low, depth + 1), moved(high, depth + 1))
                else:
                    (a, b), (c, d) = self.children[low], self.children[high]
                    made[node, depth] = self._inner(level, self._inner(level + 1, a, c), self._inner(level + 1, b, d))
            return made[node, depth]

        self.root = moved(self.root, 0)

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """``variable, kept, removed`` at each level of the path on which all pass."""
        node = self.root
        for variable in self.order:
            node, failed = self.children[node]
            yield variable, self.weights[node], self.weights[failed]


def adjacent_orders(n: int) -> Iterator[int]:
    """Levels to swap, one after another, so that all orders of ``n`` variables come up once: each variable in turn sweeps over the order of those before it."""
    if n < 2:
        return
    inner, down = adjacent_orders(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        level = next(inner, None)
        if level is None:
            return
        yield level + 1 if down else level
        down = not down


def audit_part(leaves: dict[int, Weight], names: str) -> list[tuple]:
    """Rows of ``STEPS`` without the part. ``leaves``: documents, good ones and toxic ones by failure mask."""
    n = len(names)
    diagram = Diagram(list(range(n)), leaves, 3)
    failing = [sum(w[0] for m, w in leaves.items() if m >> k & 1) for k in range(n)]
    alone = [leaves.get(1 << k, diagram.nothing)[0] for k in range(n)]
    rows, removed_in_all = [], [0] * n
    for swap in [None, *adjacent_orders(n)]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(names[k] for k in diagram.order)
        for step, (k, kept, removed) in enumerate(diagram.steps(), 1):
            removed_in_all[k] += removed[0]
            rows.append((k, order, step, kept[0], removed[0], failing[k] - removed[0], alone[k], removed[1], removed[2]))
    return [(*r[1:], removed_in_all[r[0]]) for r in rows]


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself. Words are runs of anything but ASCII white space."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", tests: Callable[[Column], dict[str, Column]] = conditions) -> DataFrame:
    """``id, part, digest, mask``: the bits of the filters that a text fails by itself, in the order of ``tests``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(tests(F.col("text")).values())), F.lit(0))
    return own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail."""
    spark = docs.sparkSession
    path = new_path(spark, "failures")
    rows = stored(failures(docs, id_col, text_col, part_col), path)
    repeated = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    rows = rows.join(small_side(repeated, 1 << 18), "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0))
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "good"), ("toxic", "bad"))]
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*marks).where("good or bad")
    rows = rows.join(small_side(marked), "id", "left")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))
    made = stored(counted, new_path(spark, "masks"))  # at most 32 rows a part
    forget(spark, path)
    return made


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included: see ``STEPS``.

    Null texts count as empty, null parts as the empty string. A filter of repeats fails a row whose text some row with a smaller id has,
    anywhere in the table; rows that share an id don't fail each other, and null ids are neither smaller nor larger. Texts are equal when their SHA-256 is. Rows that
    repeat an id share its labels; of several labels of an id one is enough. Other columns are not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        leaves = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True)}
        return pd.DataFrame([(key[0], *r) for r in audit_part(leaves, FILTERS)], columns=[c.split()[0] for c in STEPS.split(", ")])

    return masks(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(audit, STEPS)


def all_orders(names: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(names)]
