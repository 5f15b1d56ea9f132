"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of ``size`` consecutive words (an item with fewer words is one window). A window is a
set of word shingles. Shingles are ordered by how often they occur in all documents, rarest first; containment of a whole window needs its
first shingle, so that one alone is the window's necessary prefix. Documents are joined on prefix shingles by one
scan; a match gives the window's place in the document, which positional and length bounds must allow, and the words
there are compared with the window's, byte by byte.

The benchmark is the join's small side. Its index is broadcast in blocks of at most ``block_words`` words, so what a
task holds doesn't grow with either table; beyond one block the documents are scanned once for each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .runtime import cut, prepare
from .words import ALPHANUMERIC, Words, windows, words

SHINGLE = 3
BLOCK_WORDS = 1 << 20


@dataclass
class Window:
    hashes: np.ndarray
    text: bytes  #: its words, joined by one space
    items: set[str] = field(default_factory=set)

    @property
    def shingles(self) -> np.ndarray:
        return windows(self.hashes, min(SHINGLE, len(self.hashes)))


def item_windows(rows: list[Row], size: int) -> list[Window]:
    """Distinct windows of the items, with the items that have them."""
    found: dict[bytes, Window] = {}
    for chunk in words(pa.array([r.text for r in rows], pa.string()), ALPHANUMERIC):
        for row in range(chunk.rows):
            first, last = chunk.bounds[row], chunk.bounds[row + 1]
            if first == last:
                continue
            length = min(size, last - first)
            for at in range(first, last - length + 1):
                text = _text(chunk, at, length)
                window = found.setdefault(text, Window(chunk.hashes[at : at + length], text))
                window.items.add(rows[chunk.first_row + row].item_id)
    return list(found.values())


def _text(chunk: Words, at: int, length: int) -> bytes:
    return b" ".join(chunk.data[chunk.starts[k] : chunk.ends[k]].tobytes() for k in range(at, at + length))


class Index:
    """Windows by the hash of their prefix shingle, separately for each length of window."""

    def __init__(self, found: list[Window], frequency: dict[int, int]) -> None:
        by_length: dict[int, list[tuple[int, int, Window]]] = defaultdict(list)
        for window in found:
            shingles = window.shingles.tolist()
            at = min(range(len(shingles)), key=lambda k: (frequency.get(shingles[k], 0), shingles[k]))
            by_length[len(window.hashes)].append((shingles[at], at, window))
        self.parts = []
        for length, entries in sorted(by_length.items()):
            entries.sort(key=lambda e: e[0])
            keys = np.array([e[0] for e in entries], np.uint64)
            self.parts.append((length, keys, np.array([e[1] for e in entries]), np.stack([e[2].hashes for e in entries]), [e[2].text for e in entries], [e[2].items for e in entries]))

    def search(self, chunk: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items of each row that has any."""
        edges = np.zeros(len(chunk.hashes) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        row = chunk.row_of()
        for length, keys, offsets, hashes, texts, owners in self.parts:
            shingles = windows(chunk.hashes, min(SHINGLE, length))
            if not len(shingles):
                continue
            first = np.searchsorted(keys, shingles)
            at = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == shingles)
            many = np.searchsorted(keys, shingles[at], "right") - first[at]
            entry = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(at) else np.empty(0, np.int64)
            start = np.repeat(at, many) - offsets[entry]
            fits = (start >= 0) & (start + length <= len(row))
            start, entry = start[fits], entry[fits]
            fits = row[start] == row[start + length - 1]
            start, entry = start[fits], entry[fits]
            for k in range(length):
                same = chunk.hashes[start + k] == hashes[entry, k]
                start, entry = start[same], entry[same]
            for s, e in zip(start.tolist(), entry.tolist(), strict=True):
                if _text(chunk, s, length) == texts[e]:
                    edges[s] += 1
                    edges[s + length] -= 1
                    items[int(row[s])] |= owners[e]
        return np.cumsum(edges[:-1]) > 0, items


def _frequencies(docs: DataFrame, text_col: str, shingles: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each benchmark shingle occurs in all documents; what comes back is as large as the benchmark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {size: np.zeros(len(keys), np.int64) for size, keys in shingles.items()}
        for batch in batches:
            for chunk in words(batch.column(0), ALPHANUMERIC):
                for size, keys in shingles.items():
                    found = windows(chunk.hashes, size)
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    totals[size] += np.bincount(at[keys[at] == found], minlength=len(keys))
        for size, keys in shingles.items():
            seen = totals[size] > 0
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(keys[seen].view(np.int64)), "n": pa.array(totals[size][seen])})

    counted = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r.shingle % (1 << 64): r.n for r in counted.collect()}


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, size: int, block_words: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of bounded size that together cover all items, one at a time, and whether more follow."""
    spaced = F.regexp_replace(F.col("text"), "[^0-9A-Za-z\\x80-\\x{10FFFF}]+", " ")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split(spaced, " ")))).first()[0] or 0
    count = -(-total // block_words) or 1
    for k in range(count):
        found = item_windows(items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect(), size)
        by_size: dict[int, list[np.ndarray]] = defaultdict(list)
        for window in found:
            by_size[min(SHINGLE, len(window.hashes))].append(window.shingles)
        frequency = _frequencies(docs, text_col, {n: np.unique(np.concatenate(s)) for n, s in by_size.items()}) if found else {}
        yield Index(found, frequency), k + 1 < count


def _scan(batches: Iterator[pa.RecordBatch], column: str, index: Index) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[int]], list[list[str]]]]:
    """Of each row: how many words it has, the numbers of those that are hit, and the items."""
    for batch in batches:
        counts, places, owners = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for chunk in words(batch.column(column), ALPHANUMERIC):
            counts[chunk.first_row : chunk.first_row + chunk.rows] = np.diff(chunk.bounds)
            hit, items = index.search(chunk)
            for row, found in items.items():
                first, last = chunk.bounds[row], chunk.bounds[row + 1]
                places[chunk.first_row + row] = np.flatnonzero(hit[first:last]).tolist()
                owners[chunk.first_row + row] = sorted(found)
        yield batch, counts, places, owners


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Null or empty texts have no
    words; items with a null id or text have no windows; equal item texts count as separate items under their ids, and rows of one id and text share
    their items. Repeated documents each get a row. Empty tables are allowed on either side. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def spans(index: Index, all_rows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, counts, places, owners in _scan(batches, "text", index):
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(counts), pa.array(places, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string()))],
                    names=["doc_id", "key", "n_words", "places", "items"],
                )
                yield out if all_rows else out.filter(pa.array([bool(o) for o in owners], pa.bool_()))

        return rows.mapInArrow(run, "doc_id long, key long, n_words long, places array<int>, items array<string>")

    found = None
    for index, last in ((i, not more) for i, more in _blocks(docs, benchmark, text_col, size, block_words)):
        if found is None:
            found = spans(index, True) if last else cut(spans(index, True))
            continue
        more = spans(index, False).groupBy("doc_id", "key").agg(F.first("places").alias("p"), F.first("items").alias("i"))
        more = more.withColumnsRenamed({"doc_id": "d", "key": "k"})
        joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
        found = joined.select("doc_id", "key", "n_words", *(F.array_union(a, F.coalesce(b, F.array().cast(t))).alias(a) for a, b, t in (("places", "p", "array<int>"), ("items", "i", "array<string>"))))
        found = found if last else cut(found)  # the driver then lets go of this block's index
    n_hit = F.size("places").cast("long")
    named = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    prepare(docs.sparkSession)
    for index, more in _blocks(docs, benchmark, text_col, size, block_words):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch, _, _, owners in _scan(batches, text_col, index):
                yield batch.filter(pa.array([not o for o in owners], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        docs = cut(docs) if more else docs
    return docs


