"""Exact Jaccard join of documents' shingle sets, up to connectivity: a metric-space join around pivots.

Distance is one minus Jaccard similarity. Sets with no common shingle are all at distance 1, where no pivot tells them apart, so the
first regions come from a necessary condition: two sets that link share one of the first ``n - ceil(0.75 n) + 1`` shingles of each in one
common order, in which shingles of many documents come last. Each such shingle makes a region.

1. The pivot of a region is its most central set, the one with the least share of rare shingles. The exact distance of every set to the pivots of
   its regions is computed; the nearest ones within the threshold make its Voronoi cell, and cells that share a set merge.
2. Sets outside the main cell of a large region form a region again, with a pivot of their own, and so on until no cell changes (recursion).
3. What may still link lies in different cells of one region. Windows say which sets a cell must see: distances to
   the region's pivot that differ by at most the threshold (triangle inequality), sizes, and an upper bound of the intersection
   from the rare shingles that can't be shared. Only these replicas are compared, exactly. In regions of rare shingles the pairs of different cells
   are counted over all shingles they meet in, which bounds their intersection as well.

Pairs inside a cell are never listed: only connectivity is returned. Sets that are equal throughout the table are one member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import DENOMINATOR, NUMERATOR, cells_of, close, in_cells, links, near_sizes, pair, whole_regions
from .components import components
from .runtime import counted, cut, dealt, few_files, forget, keyed, new_path, packed, prepare, small_side, smaller_batches, stored
from .words import NON_SPACE, mix, shingle_sets, words

SHINGLE = 5
FREQUENT = 48  #: shingles of more documents come last in the order, and their regions join by windows
FREQUENT_LISTED = 1 << 19  #: at most so many of them; the regions of others are found by their size
LOCAL = 3
BLOCK = 256  #: pairs of one set that a task compares with one copy of it
SET_ROWS = 200  #: rows of whole texts in a batch
ASKED_ROWS = 1 << 20  #: texts that one pass over the documents picks out for comparison

PARTS = "key long, n long, rep long, f1 long, f2 long, r long, rare array<long>, frequent array<long>"
REGION = "shingle long, key long, n long, r long, many long, pivot long, pivot_n long"


def prefix_length(n):
    """How many first shingles of a set of ``n`` any set that links must meet."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


Sets = Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]


def document_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers and sorted shingles of whole texts."""
    for chunk in words(column, NON_SPACE):
        hashes, bounds = shingle_sets(chunk, SHINGLE)
        for row in range(chunk.rows):
            yield chunk.first_row + row, hashes[bounds[row] : bounds[row + 1]]


def _fingerprint(own: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums of a set. Sets with equal ones count as equal, as shingles with equal hashes do."""
    if not len(own):
        return 0, 0, 0
    folded = np.array([np.bitwise_xor.reduce(own), mix(own ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)]).view(np.int64)
    return len(own), int(folded[0]), int(folded[1])


def _frequent(rows: DataFrame, limit: int, sets: Sets) -> np.ndarray:
    """Sorted shingles in more than ``limit`` documents, at most ``FREQUENT_LISTED`` of them.

    Counts start in the input partitions, over distinct sets; a shingle that is rarer than ``LOCAL`` in each of them is
    not found here but when its region shows. Which shingles are listed changes the order, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        kept, totals = [], (np.empty(0, np.uint64), np.empty(0, np.int64))
        size = 0

        def fold(kept, totals):
            keys = np.concatenate([totals[0], *kept])
            n = np.concatenate([totals[1], np.ones(len(keys) - len(totals[0]), np.int64)])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
            return (keys[first], np.add.reduceat(n, first)) if len(first) else totals

        for batch in batches:
            for _, own in sets(batch.column(1)):
                if len(own) and (mark := _fingerprint(own)) not in seen:
                    seen.add(mark)
                    kept.append(own.copy())
                    size += len(own)
                    if size > 1 << 19:
                        keys, n = fold(kept, totals)
                        if len(keys) > 1 << 19:  # keep what has been seen twice; the rest starts again
                            keys, n = keys[n > 1], n[n > 1]
                        kept, totals, size = [], (keys, n), 0
        keys, n = fold(kept, totals)
        often = n >= LOCAL
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

    counted = rows.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") > limit).orderBy(F.desc("n"), "shingle").limit(FREQUENT_LISTED).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in top], np.int64).view(np.uint64))


def _parts(rows: DataFrame, frequent: np.ndarray, sets: Sets) -> DataFrame:
    """Each document's set size and first shingles, rare and frequent ones apart. Of equal sets in a partition only the first
    one met (``rep``) has shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for row, own in sets(batch.column(1)):
                mark, rare, often, r = _fingerprint(own), own[:0], own[:0], 0
                rep = seen.setdefault(mark, keys[row]) if len(own) else keys[row]
                if len(own) and rep == keys[row]:
                    at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
                    known = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
                    r, first = int((~known).sum()), prefix_length(len(own))
                    rare, often = own[~known][:first], own[known][: max(0, first - r)]
                out.append((keys[row], len(own), rep, *mark[1:], r, rare.view(np.int64), often.view(np.int64)))
            kinds = (*[pa.int64()] * 6, *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in PARTS.split(", ")])

    return rows.mapInArrow(make, PARTS)


def _rare_regions(members: DataFrame) -> DataFrame:
    """Members of regions of at least two, with the region's size and pivot. ``members``: ``shingle, key, n, r``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _, many in whole_regions(batches):
            columns = [c[np.repeat(many > 1, many)] for c in columns]
            many = many[many > 1]
            if len(many):
                shingle, key, n, r = (c[np.lexsort((columns[1], columns[3] / columns[2], columns[0]))] for c in columns)
                pivot = np.repeat(np.cumsum(many) - many, many)
                out = (shingle, key, n, r, np.repeat(many, many), key[pivot], n[pivot])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in REGION.split(", ")])

    return members.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(make, REGION)


def _frequent_regions(members: DataFrame) -> DataFrame:
    """The same for the listed shingles, of which there is a bounded number: members don't move."""
    central = F.min(F.struct(F.expr("r / n"), "key", "n")).alias("p")
    pivots = small_side(members.groupBy("shingle").agg(F.count("*").alias("many"), central).select("shingle", "many", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")))
    return members.join(pivots, "shingle").select("shingle", "key", "n", "r", "many", "pivot", "pivot_n")


def verified(pairs: DataFrame, rows: DataFrame, sets: Sets = document_sets) -> DataFrame:
    """``a, b, distance, linked`` of distinct pairs of keys, by their complete sets.

    Of each pair the set in more pairs is the hub; a block of up to ``BLOCK`` of a hub's pairs gets one copy of it, so a hub of any number of pairs is
    sent once a block and its blocks are spread. Texts are sent, which are shorter than their sets, and only those in a pair: what is asked of the rows
    is broadcast in portions of about ``ASKED_ROWS``, with a pass over ``rows`` for each, so the texts of the whole table are never shuffled.
    """
    pairs = cut(few_files(pairs.select("a", "b")))
    many = counted(pairs)
    pairs = dealt(pairs, many)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    degrees = small_side(ends.groupBy("id").agg(F.count("*").alias("degree")))
    both = pairs.join(degrees.withColumnsRenamed({"id": "a", "degree": "da"}), "a").join(degrees.withColumnsRenamed({"id": "b", "degree": "db"}), "b")
    first = F.col("da") >= F.col("db")
    placed = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.greatest("da", "db").alias("d"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("d") / BLOCK)))
    hubs = placed.select("hub", "block").distinct().select("hub", "block", F.col("hub").alias("id"), F.lit(0).alias("role"))
    asked = packed(hubs.unionByName(placed.select("hub", "block", "id", F.lit(1).alias("role"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, whole = None, np.empty(0, np.uint64)
        for batch in batches:
            names, ids, roles = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for row, own in sets(batch.column(3)):
                name, key = names[row], ids[row]
                if roles[row] == 0:
                    hub, whole = name, own.copy()
                    continue
                assert hub == name
                at = np.minimum(np.searchsorted(whole, own), max(len(whole) - 1, 0))
                shared = int((whole[at] == own).sum()) if len(whole) else 0
                union = len(own) + len(whole) - shared
                out.append((min(key, hub), max(key, hub), 1 - shared / union if union else 0.0, links(len(own), len(whole), shared)))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["a", "b", "distance", "linked"])

    passes, found = max(1, -(-counted(asked) // ASKED_ROWS)), None
    with smaller_batches(rows.sparkSession, SET_ROWS):
        for k in range(passes):
            own = asked.where(F.pmod(F.xxhash64("hub", "block"), F.lit(passes)) == k)
            chosen = rows.select(F.col("key").alias("id"), "text").join(F.broadcast(own), "id").select("hub", "id", "role", "text", "block")
            blocks = chosen.repartition("hub", "block").sortWithinPartitions("hub", "block", "role")
            made = dealt(cut(blocks.mapInArrow(compare, "a long, b long, distance double, linked boolean")), many)
            found = made if found is None else found.unionByName(made)
    return found


def _rare_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different cells in small regions of rare shingles that may link. ``members``: ``shingle, key, n, tail, c``.

    A pair is counted once for each first shingle that it shares. Beyond those, two sets can share no more than the last ones among
    their first shingles (``tail``: frequent, or of large regions) and what follows in the longer rest.
    """
    names = ("a", "b", "na", "nb", "ta", "tb", "k")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first, many in whole_regions(batches):
            c = columns[4]
            mixed = np.repeat(np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first), many)
            shingle, key, n, tail, c = (x[mixed] for x in columns)
            live, step = np.arange(len(shingle)), 1
            while len(live := live[live + step < len(shingle)]) and len(live := live[shingle[live] == shingle[live + step]]):
                other = live + step
                fits = (c[live] != c[other]) & (DENOMINATOR * np.minimum(n[live], n[other]) >= NUMERATOR * np.maximum(n[live], n[other]))
                x, y = live[fits], other[fits]
                if len(x):
                    x, y = np.where(key[x] < key[y], x, y), np.where(key[x] < key[y], y, x)
                    rows, k = np.unique(np.stack([key[x], key[y], n[x], n[y], tail[x], tail[y]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in (*rows, k)], names=list(names))
                step += 1

    placed = members.select("shingle", "key", "n", "tail", "c").repartition("shingle").sortWithinPartitions("shingle", "key")
    met = placed.mapInArrow(pairs, ", ".join(f"{c} long" for c in names)).groupBy(*names[:-1]).agg(F.sum("k").alias("k"))
    after = [F.ceil(F.lit(NUMERATOR) * F.col(c) / F.lit(DENOMINATOR)) - 1 for c in ("na", "nb")]
    most = F.col("k") + F.least("ta", "tb") + F.greatest(*after)
    return met.where((NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("na") + F.col("nb"))).select("a", "b")


def set_components(rows: DataFrame, frequent: int = FREQUENT, sets: Sets = document_sets) -> DataFrame:
    """``key, n, c`` of rows ``key, text`` with unique keys: set size, and the least key reachable by links. ``sets`` makes the sets of texts."""
    spark = rows.sparkSession
    paths = [new_path(spark, f"jaccard-{name}") for name in ("parts", "regions")]
    parts = stored(_parts(rows, _frequent(rows, frequent, sets), sets), paths[0])

    firsts = parts.where("key = rep and n > 0")
    equal = firsts.groupBy("n", "f1", "f2").agg(F.min("key").alias("low"), F.count("*").alias("many")).where("many > 1").drop("many")
    folded = packed(firsts.select("key", "n", "f1", "f2").join(small_side(equal), ["n", "f1", "f2"]).where("low < key").select(F.col("low").alias("a"), F.col("key").alias("b")))
    members = firsts.join(small_side(folded.select(F.col("b").alias("key"))), "key", "left_anti")

    rare = _rare_regions(members.select(F.explode("rare").alias("shingle"), "key", "n", "r"))
    often = _frequent_regions(members.select(F.explode("frequent").alias("shingle"), "key", "n", "r"))
    regions = stored(rare.withColumn("listed", F.lit(False)).unionByName(often.withColumn("listed", F.lit(True))), paths[1])

    around = regions.where((F.col("key") != F.col("pivot")) & near_sizes("n", "pivot_n")).select(*pair("key", "pivot")).distinct()
    distances = verified(around, rows, sets)
    edges = packed(distances.where("linked").select("a", "b"))
    cells = cells_of(edges)

    small = ~F.col("listed") & (F.col("many") <= 2 * frequent)
    full = F.when(F.col("listed"), F.col("n") - F.col("r")).otherwise(F.col("n")).alias("full")
    large = regions.where(~small)
    asked = None
    if not large.isEmpty():
        d = small_side(distances.select(F.col("a").alias("x"), F.col("b").alias("y"), "distance"))
        placed = large.withColumns({"x": F.least("key", "pivot"), "y": F.greatest("key", "pivot")}).join(d, ["x", "y"], "left")
        apart = F.when(F.col("key") == F.col("pivot"), 0.0).otherwise(F.col("distance")).alias("d")
        placed = packed(placed.select(F.col("shingle").alias("region"), "key", "n", full, apart))
        edges, asked = close(placed, edges, cells, lambda pairs: verified(pairs, rows, sets).where("linked").select("a", "b"))
        cells = cells_of(edges)
    unlisted = small_side(large.where(~F.col("listed")).groupBy("key").agg(F.count("*").alias("more")))
    first = F.col("n") - F.ceil(F.lit(NUMERATOR) * F.col("n") / F.lit(DENOMINATOR)) + 1
    tail = F.greatest(first - F.col("r"), F.lit(0)) + F.coalesce("more", F.lit(0))
    rest = _rare_pairs(in_cells(regions.where(small).join(unlisted, "key", "left").withColumn("tail", tail.cast("long")), cells))
    rest = rest if asked is None else rest.unionByName(asked).distinct()
    more = verified(rest.join(distances.select("a", "b"), ["a", "b"], "left_anti"), rows, sets).where("linked").select("a", "b")

    same = cut(parts.select("key", "n", "rep"))
    within = same.groupBy("rep").agg(F.min("key").alias("low")).where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    found = components(cut(edges.unionByName(more).unionByName(folded).unionByName(within)))
    for path in paths:
        forget(spark, path)
    return same.join(found.withColumnsRenamed({"node": "rep", "component": "c"}), "rep", "left").select("key", "n", F.coalesce("c", "rep").alias("c"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the least id reachable by links, its own included.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; sets hold distinct runs of five words, a shorter text's
    whole sequence being one. Texts that are null or without words link with nothing. Every row is a document of its own, also where
    rows repeat an id or have none; a component without any id has a null one. Other columns are not read; an
    empty table gives an empty result. Equality of shingles is that of 64-bit hashes.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, key = keyed(own, "doc_id", nulls_last=True)
    found = set_components(rows.select(F.col(key).alias("key"), "text"), frequent)
    ids = rows.select(F.col(key).alias("key"), "doc_id")
    least = ids.select(F.col("key").alias("c"), F.col("doc_id").alias("component_id"))  # keys ascend with ids, nulls last
    if key == "doc_id":
        return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    return found.join(ids, "key").join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
