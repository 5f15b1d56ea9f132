"""Joins inside regions, groups of rows that share a key, up to connectivity: only pairs of different cells are compared.

Cells are the components of links found so far. Two sets link at a Jaccard similarity of at least ``NUMERATOR / DENOMINATOR``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, packed, small_side

NUMERATOR, DENOMINATOR = 75, 100


def links(size_a, size_b, shared):
    """Whether two sets link, from their sizes and the size of their intersection."""
    return DENOMINATOR * shared >= NUMERATOR * (size_a + size_b - shared)


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of rows sorted by their first column, in portions that hold whole regions; each region's first row and size."""
    rest: list[np.ndarray] | None = None
    for batch in with_end(batches):
        own = [c.to_numpy() for c in batch.columns] if batch is not None else None
        columns = own if rest is None else rest if own is None else [np.concatenate(both) for both in zip(rest, own, strict=True)]
        if columns is None or not len(columns[0]):
            continue
        end = len(columns[0]) if batch is None else int(np.searchsorted(columns[0], columns[0][-1]))
        rest = [c[end:] for c in columns]
        if end:
            columns = [c[:end] for c in columns]
            first = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
            yield columns, first, np.diff(np.append(first, end))


def near_sizes(n: str, m: str) -> Column:
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def cells_of(edges: DataFrame) -> DataFrame:
    """``key, c`` of all keys with an edge."""
    return small_side(components(edges).withColumnsRenamed({"node": "key", "component": "c"}))


def in_cells(members: DataFrame, cells: DataFrame) -> DataFrame:
    return members.join(cells, "key", "left").withColumn("c", F.coalesce("c", "key"))


def close(members: DataFrame, edges: DataFrame, cells: DataFrame, linked: Callable[[DataFrame], DataFrame], pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """All edges after recursion over what lies outside the main cells, and the pairs that are still to be compared.

    ``members``: ``region, key, n, full, d``. Two sets of a region share at most the smaller ``full``, or are compared elsewhere. ``d`` is the
    distance to a pivot of the region, or null. ``linked`` gives the linked ones of distinct pairs ``a, b``. The sets outside a region's main cell
    form a region with a pivot of its own, the set of the largest share ``full / n``; that repeats until no cell changes. Pairs that windows
    (cells, sizes, ``full``, distances to the pivot by the triangle inequality) don't exclude are left to the caller; without ``pairs``, the members of
    regions of several cells are, with their cell ``c``, but for those whose ``full`` is too small for any link.
    """
    bound = (NUMERATOR + DENOMINATOR) * F.least("full", "o_full") >= NUMERATOR * (F.col("n") + F.col("o_n"))
    may = (F.col("c") != F.col("o_c")) & near_sizes("n", "o_n") & bound
    within = F.coalesce(F.abs(F.col("d") - F.col("o_d")) <= 1 - NUMERATOR / DENOMINATOR + 1e-9, F.lit(True))
    asked = None
    while True:
        named = in_cells(members, cells)
        sizes = named.groupBy("region", "c").count().groupBy("region")
        main = small_side(sizes.agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("cells")).where("cells > 1").drop("cells"))
        state = cut(named.join(main, "region"))
        outside = state.where("c <> main")
        central = F.min(F.struct(F.expr("1 - full / n"), F.col("key").alias("o"), F.col("n").alias("o_n"), F.col("full").alias("o_full"), F.col("c").alias("o_c")))
        pivots = small_side(outside.groupBy("region").agg(central.alias("p")).select("region", "p.*"))
        found = outside.join(pivots, "region").where(may).select(*pair("key", "o")).distinct()
        found = packed(found if asked is None else found.join(asked, ["a", "b"], "left_anti"))
        if found.isEmpty():
            break
        asked = found if asked is None else cut(asked.unionByName(found))
        more = packed(linked(found))
        if more.isEmpty():
            break
        edges = cut(edges.unionByName(more))
        cells = cells_of(edges)
    if not pairs:
        return edges, state.where(F.col("full") * DENOMINATOR >= F.col("n") * NUMERATOR).select("region", "key", "n", "full", "c")
    others = small_side(outside.select("region", *(F.col(c).alias(f"o_{c}") for c in ("key", "n", "full", "c", "d"))))
    left = state.join(others, "region").where(may & within).select(*pair("key", "o_key")).distinct()
    return edges, cut(left if asked is None else left.join(asked, ["a", "b"], "left_anti"))
