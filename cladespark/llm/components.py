"""Connected components of a graph that is only ever held as a distributed table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import TASK_ROWS, counted, cut, dealt

HELD = 2 * TASK_ROWS  #: edges that a task replaces by stars at a time


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of every node with an edge. ``edges``: ``a, b`` of type long, as ``cut`` gives them (they are read twice).

    Each task first replaces its edges by stars around the least nodes. If few edges are left, one task does so for all of them, and that is the result. Else alternating
    large-star and small-star steps follow; each halves the distance to the least node or better, so a star or a
    chain of n nodes takes about log n rounds. A node with very many edges is pre-aggregated for its minimum, and its
    rows of the join are left to adaptive skew splitting. Lineage is cut after each round, into as many files as its edges need.
    """
    many = counted(edges)
    current, state = _stars(dealt(edges, many)), (0,)
    if many > TASK_ROWS:
        current = cut(dealt(current.distinct(), many))
        state = _state(current)
        if state[0] <= TASK_ROWS:
            current, state = _stars(dealt(current, state[0])), (0,)
    if not state[0]:
        current = cut(current)
    while state[0]:
        current = dealt(current, state[0])
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = large.join(low, F.col("a") == F.col("u")).select("a", "b", "m")
        small = moved.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        current = cut(dealt(small, 2 * state[0]))
        last, state = state, _state(current)
        if last == state:
            break
    own = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the least of their component, and the least one, for the edges given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while (apart := low[x] != low[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
        while ((deep := low[low]) != low).any():
            low = deep
    own = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[own], nodes[low[own]]


def _stars(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` (``a > b``) with the same components; of a task's edges, those between each node and the least one they reach."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= HELD:
                yield star(held)
                held, size = [], 0
        if size:
            yield star(held)

    def star(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _least(*map(np.concatenate, zip(*held, strict=True)))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(make, "a long, b long")


def _state(edges: DataFrame) -> tuple:
    edges = edges.coalesce(edges.sparkSession.sparkContext.defaultParallelism)
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
