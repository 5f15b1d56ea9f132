"""Product codes of vectors: integer k-means of each part by balls, and two hex digits a part.

An entry and the parts assigned to it are a ball. An entry further from a ball's centre than twice a part's own distance can't be nearer to
that part, so each part sees only a ring of the ball's neighbours, sorted by distance: none in the stable core, more further out. A ball whose
entry and whose neighbours, as its radius defines them, haven't moved keeps its parts unseen. All distances are exact integers.

Vectors stay in tables in the shared folder, split as they were read; what travels is the sums of each task, a row for each entry of each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, new_path, prepare, small_side, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 26  #: integer components are below it, so squared distances fit in 64 bits
TOGETHER = 1 << 14  #: rows that a task compares at a time


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``y`` (64-bit integers): by floating point while every intermediate result is an integer below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of one key."""
    edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


@dataclass
class Balls:
    """The entries of one part position with, for each, all entries by distance."""

    entries: np.ndarray  #: one entry a row
    near: np.ndarray  #: indexes of all entries, nearest first
    gaps: np.ndarray  #: their squared distances
    still: np.ndarray  #: balls that no part can leave: neither their entry nor a neighbour has moved

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None, radii: np.ndarray | None = None) -> Balls:
        """``radii``: of the balls around the entries ``before``, squared; -1 where a ball is empty."""
        apart = squared(entries, entries)
        near = np.argsort(apart, axis=1, kind="stable")
        still = np.zeros(len(entries), bool)
        if before is not None and radii is not None:
            moved = ((entries - before) ** 2).sum(1)
            for k in range(len(entries)):
                reach = isqrt(max(int(radii[k]), 0)) + isqrt(int(moved[k])) + 2  # of the ball around the moved entry, rounded up
                still[k] = not moved[apart[k] <= 4 * reach * reach].any()
        return cls(entries, near, np.take_along_axis(apart, near, 1), still)

    def nearest(self, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Each row's nearest entry, the lower index on ties. ``own``: its last entry, under the entries that ``still`` was made with."""
        if own is None:
            return squared(x, self.entries).argmin(1)
        found = own.copy()
        rows = np.flatnonzero(~self.still[own])
        seen = 4 * ((x[rows] - self.entries[own[rows]]) ** 2).sum(1)
        order = np.argsort(own[rows], kind="stable")
        rows, seen = rows[order], seen[order]
        ring = np.empty(len(rows), np.int64)
        for a, b in _runs(own[rows]):
            ring[a:b] = np.searchsorted(self.gaps[own[rows[a]]], seen[a:b], "right")
        width = 2
        while width // 2 < len(self.entries):  # entries in the ring: over width / 2, up to width
            here = np.flatnonzero((ring > width // 2) & (ring <= width))
            if 2 * width > len(self.entries):
                here = np.flatnonzero(ring > width // 2)
                for a in range(0, len(here), TOGETHER):
                    part = rows[here[a : a + TOGETHER]]
                    found[part] = squared(x[part], self.entries).argmin(1)
                break
            for a, b in _runs(own[rows[here]]):
                part = rows[here[a:b]]
                candidates = np.sort(self.near[own[part[0]], :width])
                found[part] = candidates[squared(x[part], self.entries[candidates]).argmin(1)]
            width *= 2
        return found


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _codes(column: pa.Array, parts: int) -> np.ndarray | None:
    """Last codes, a row of 16-bit indexes for each vector; none in the first round."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), parts).astype(np.int64) if column.null_count == 0 else None


def _assigned(rows: DataFrame, balls: list[Balls]) -> DataFrame:
    """``rows`` (``id, label, v, code``) with new codes and ``error``, the squared distances summed over parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            v, last = _matrix(batch.column(2)), _codes(batch.column(3), len(balls))
            width = v.shape[1] // len(balls)
            code, error = np.empty((len(v), len(balls)), "<u2"), np.zeros(len(v), np.int64)
            for p, ball in enumerate(balls):
                x = v[:, p * width : (p + 1) * width]
                own = ball.nearest(x, None if last is None else last[:, p])
                code[:, p] = own
                error += ((x - ball.entries[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["id", "label", "v", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("id", "label", "v", "code").mapInArrow(make, f"{kinds}, error long" if "error" not in rows.columns else kinds)


def _moved(rows: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New entries (floor of the mean of their parts; unused ones stay) and the squared radii of the balls around the old ones."""
    parts, entries, width = codebooks.shape

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, total = np.zeros((parts, entries), np.int64), np.full((parts, entries), -1), np.zeros(codebooks.shape, np.int64)
        for batch in _portions(batches):
            v, code = _matrix(batch.column(0)), _codes(batch.column(1), parts)
            for p in range(parts):
                x, own = v[:, p * width : (p + 1) * width], code[:, p]
                n[p] += np.bincount(own, minlength=entries)
                np.add.at(total[p], own, x)
                np.maximum.at(radius[p], own, ((x - codebooks[p][own]) ** 2).sum(1))
        at = np.nonzero(n)
        out = [pa.array(a.astype(np.int64)) for a in (*at, n[at], radius[at])]
        yield pa.RecordBatch.from_arrays([*out, pa.array(list(total[at]), pa.list_(pa.int64()))], names=["part", "entry", "n", "radius", "total"])

    made = rows.select("v", "code").mapInArrow(make, "part long, entry long, n long, radius long, total array<long>")
    sums = [F.sum(F.col("total")[k].cast("decimal(38,0)")) for k in range(width)]
    new, radii = codebooks.copy(), np.full((parts, entries), -1)
    for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.array(*sums).alias("total")).collect():  # a row an entry
        new[r.part, r.entry] = [int(t) // int(r.n) for t in r.total]
        radii[r.part, r.entry] = r.radius
    return new, radii


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, v, code``: integer vectors without those that are null or hold null or non-finite components."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * SCALE))
    return own.where(F.col("x").isNotNull() & finite).select("id", "label", whole.alias("v"), F.lit(None).cast("binary").alias("code"))


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that has only finite components.

    Codebooks start as the parts of the first ``entries`` vectors by id (null ids last, equal ids by their components; fewer vectors make
    smaller codebooks). Rows that repeat an id are vectors of their own. Ties go to the lower index. Other columns are not read; an empty table, or one without usable
    vectors, gives an empty result. Vectors of unequal lengths, of a length that isn't a multiple of ``parts``, or with components of 65536 or more raise a
    ``ValueError``, as their squared distances might not fit in a long. ``label_error`` sums over rows of one label, nulls being one.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark = vectors.sparkSession
    prepare(spark)
    path = new_path(spark, "vectors")
    rows = stored(_usable(vectors, id_col, vector_col, label_col), path)
    extent = F.max(F.greatest(F.array_max("v"), -F.array_min("v")))
    low, high, largest = rows.agg(F.min(F.size("v")), F.max(F.size("v")), extent).first()
    if low is not None and (low != high or low % parts or (largest or 0) >= LARGEST):
        raise ValueError(f"vectors of {low} to {high} components up to {largest}: lengths must be equal and divisible by {parts}, components below {LARGEST}")
    first = [r.v for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, -1 if first and low else 0).transpose(1, 0, 2)
    balls = [Balls.of(b) for b in books]
    for _ in range(rounds if first else 0):
        assigned = new_path(spark, "vectors")
        rows = stored(_assigned(rows, balls), assigned)
        forget(spark, path)
        path, before = assigned, books
        books, radii = _moved(rows, books)
        balls = [Balls.of(*each) for each in zip(books, before, radii, strict=True)]
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    coded = stored(_assigned(rows, balls).select("id", "label", "code", "error"), new_path(spark, "codes"))
    forget(spark, path)
    totals = small_side(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    digits = F.concat(*(F.substring(F.hex("code"), 4 * p + 1, 2) for p in range(parts)))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), F.lower(digits).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
