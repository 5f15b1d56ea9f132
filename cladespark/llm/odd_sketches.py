"""Near-duplicate documents: banded MinHash finds candidates, odd sketches weigh them, full shingle sets confirm them.

A set's samples are the least hash in each of ``SAMPLES`` equal ranges of hashes; an empty range borrows that of the first filled one in an order of
its own, so each sample of two sets agrees with a probability equal to their similarity. The first samples make bands. All of them, each with its number, are
folded into a bitmap by flipping one bit: where two sets agree the flips cancel out, so the population count of the XOR of two bitmaps tells how many samples differ,
the more precisely the more similar the sets are. Candidates whose count is improbable at the threshold (``DEVIATIONS``) are dropped, the others
are compared by their complete sets.

Equal sets are one member. Members meet in buckets (band and hash) of any size, and only connectivity is asked for:

1. The most central member of a bucket, the one that meets the most others over all its buckets, is compared with the rest. Linked members make cells.
2. In buckets with more than one cell, the most central member outside the largest cell is compared with other cells, until that links nothing.
3. What is left, members outside the largest cell against all others, is compared in regions, the buckets that have one largest cell, block by block with complete
   sets; only links leave a task. Shingles that no other document there has can't be shared, so they bound every similarity from above: a member with too
   many of them links with nothing and goes, and pairs must pass the bound, then their bitmaps, before their sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import in_cells, pair
from .components import components
from .jaccard_join import Sets, verified
from .runtime import cut, forget, keyed, new_path, prepare, small_side, smaller_batches, stored
from .words import NON_SPACE, mix, shingle_sets, words

SHINGLE = 4
NUMERATOR, DENOMINATOR = 80, 100
SAMPLES, BITS = 1024, 2048
BANDS, BAND = 32, 4  #: sets at similarity 0.8 share no band with a probability of 5e-8
DEVIATIONS = 6
BLOCK = 256  #: members of a region, on either side, that a task compares at a time
SET_ROWS = 200  #: rows of whole sets in a batch

SKETCH = "key long, n long, f1 long, f2 long, bands array<long>, odd array<long>"


def differing_bits(similarity: float, deviations: float) -> int:
    """How many bits of two bitmaps differ at most, so many standard deviations above the mean.

    Borrowed samples repeat others, which at most doubles the variance of the share of samples that differ.
    """
    differ = 2 * SAMPLES * (1 - similarity)
    left = exp(-2 * differ / BITS)
    of_samples = 2 * SAMPLES * sqrt(2 * similarity * (1 - similarity) / SAMPLES) * left
    of_bits = BITS / 4 * (1 - left * left)
    return int(BITS / 2 * (1 - left) + deviations * sqrt(of_samples**2 + of_bits)) + 1


MOST_BITS = differing_bits(NUMERATOR / DENOMINATOR, DEVIATIONS)


@lru_cache(1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each range the order in which it asks others, itself first; and the place of each range in that order."""
    order = np.random.default_rng(20260301).permuted(np.tile(np.arange(SAMPLES, dtype=np.int16), (SAMPLES, 1)), axis=1)
    own = np.arange(SAMPLES)
    at = np.nonzero(order == own[:, None])[1]
    order[own, at], order[own, 0] = order[own, 0], own
    place = np.empty_like(order)
    np.put_along_axis(place, order.astype(np.int64), np.broadcast_to(np.arange(SAMPLES, dtype=np.int16), order.shape), 1)
    return order, place


def samples(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of samples for each set; rows of empty sets mean nothing. ``hashes``: of set ``k`` in ``bounds[k]:bounds[k + 1]``, ascending."""
    order, place = _orders()
    rows = len(bounds) - 1
    row, bins = np.repeat(np.arange(rows), np.diff(bounds)), (hashes >> np.uint64(64 - SAMPLES.bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.diff(row * SAMPLES + bins, prepend=-1))
    value, filled = np.zeros((rows, SAMPLES), np.uint64), np.zeros((rows, SAMPLES), bool)
    value[row[least], bins[least]] = hashes[least]
    filled[row[least], bins[least]] = True
    many = filled.sum(1)
    for r in np.flatnonzero((many > 0) & (many <= SAMPLES // 8)):
        known = np.flatnonzero(filled[r])
        value[r] = value[r, known[place[:, known].argmin(1)]]
    r, k = np.nonzero(~filled & (many > SAMPLES // 8)[:, None])
    asked = 1
    while len(r):
        other = order[k, asked]
        found = filled[r, other]
        value[r[found], k[found]] = value[r[found], other[found]]
        r, k, asked = r[~found], k[~found], asked + 1
    return value


def bitmaps(value: np.ndarray) -> np.ndarray:
    """Samples of each row folded into bits, as 64-bit words."""
    numbered = mix(value + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = (numbered % np.uint64(BITS)).astype(np.int64) + np.arange(len(value))[:, None] * BITS
    odd = (np.bincount(at.ravel(), minlength=len(value) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(value), BITS), axis=1).view(np.uint64)


def bands(value: np.ndarray) -> np.ndarray:
    first = value[:, : BANDS * BAND].reshape(-1, BANDS, BAND)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    total = np.broadcast_to(total, first.shape[:2])
    for k in range(BAND):
        total = mix(total ^ first[:, :, k])
    return total


def document_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers and sorted shingles of whole texts."""
    for chunk in words(column, NON_SPACE):
        hashes, bounds = shingle_sets(chunk, SHINGLE)
        for row in range(chunk.rows):
            yield chunk.first_row + row, hashes[bounds[row] : bounds[row + 1]]


def _lists(values: np.ndarray, own: np.ndarray) -> pa.Array:
    """A list of longs for each row, empty where ``own`` is false."""
    at = np.concatenate(([0], np.cumsum(np.where(own, values.shape[1], 0))))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(values[own]).view(np.int64).ravel()))


def sketches(rows: DataFrame) -> DataFrame:
    """Set size, two sums that tell sets apart, bands and bitmap of rows ``key, text``; bands and bitmap of empty sets are empty lists."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(1), NON_SPACE):
                hashes, bounds = shingle_sets(chunk, SHINGLE)
                n = np.diff(bounds)
                sums = np.zeros((2, len(n)), np.uint64)
                if len(hashes):
                    for k, each in enumerate((hashes, mix(hashes ^ np.uint64(0x94D049BB133111EB)))):
                        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
                        sums[k] = total[bounds[1:]] - total[bounds[:-1]]
                value = samples(hashes, bounds)
                columns = [batch.column(0).slice(chunk.first_row, chunk.rows), pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums)]
                yield pa.RecordBatch.from_arrays([*columns, _lists(bands(value), n > 0), _lists(bitmaps(value), n > 0)], names=[c.split()[0] for c in SKETCH.split(", ")])

    return rows.select("key", "text").mapInArrow(make, SKETCH)


def whole_sets(rows: DataFrame) -> DataFrame:
    """``key, own`` of rows ``key, text``: the sorted shingles as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(keys[row], own.tobytes()) for row, own in document_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["key", "own"])

    return rows.select("key", "text").mapInArrow(make, "key long, own binary")


def near_sizes(n: str, m: str) -> Column:
    return DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)


def similar_bitmaps(pairs: DataFrame, odd: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose bitmaps may belong to sets that link. ``odd``: ``key, odd``."""
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    sides = [odd.select(F.col("key").alias(k), F.col("odd").alias(x)) for k, x in (("a", "x"), ("b", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(differ <= MOST_BITS).select("a", "b")


def alone_sizes(rows: DataFrame, sets: Sets = document_sets) -> DataFrame:
    """``key, alone``: how many shingles of each set no other one of ``rows`` (``key, text``, unique keys) has."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, own in sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), keys[row])), pa.array(own.view(np.int64))], names=["key", "shingle"])

    met = rows.select("key", "text").mapInArrow(make, "key long, shingle long").groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    alone = met.where("key = other").groupBy("key").agg(F.count("*").alias("alone"))
    sizes = rows.select("key").join(small_side(alone), "key", "left")
    return sizes.select("key", F.coalesce("alone", F.lit(0)).alias("alone"))


def _left_links(regions: DataFrame, odd: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of different cells in a region, one of them outside its largest cell, between members that sizes, shared shingles and bitmaps don't exclude.

    ``regions``: ``main, key, n, full, c``, distinct; two sets share at most the smaller ``full``. ``odd``: ``key, odd``; ``sets``: ``key, own``, sorted shingles as bytes. Both
    sides of a region are dealt into blocks by their keys; a group is one block of each, and compares complete sets, so only links leave it.
    """
    outside = (F.col("c") != F.col("main")).alias("outside")
    sizes = regions.groupBy("main").agg(F.count_if(F.col("c") != F.col("main")).alias("few"), F.count("*").alias("many")).where("few > 0")
    blocks = [F.ceil(F.col(c) / BLOCK).cast("long").alias(b) for c, b in (("few", "left_blocks"), ("many", "right_blocks"))]
    rows = regions.join(sizes.select("main", *blocks), "main").select("main", "key", "n", "full", "c", outside, "left_blocks", "right_blocks")
    dealt = [F.pmod(F.xxhash64("key", F.lit(k)), F.col(c)) for k, c in enumerate(("left_blocks", "right_blocks"))]
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("left_blocks", "right_blocks")]
    left = rows.where("outside").select("main", dealt[0].alias("i"), each[1].alias("j"), F.lit(0).alias("side"), "key", "n", "full", "c", "outside")
    right = rows.select("main", each[0].alias("i"), dealt[1].alias("j"), F.lit(1).alias("side"), "key", "n", "full", "c", "outside")
    placed = left.unionByName(right).join(odd, "key").join(sets, "key").select("main", "i", "j", "side", "key", "n", "full", "c", "outside", "odd", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, key, n, full, c, outer, bits, own in _groups(batches):
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for a in x:
                fits = (c[a] != c[y]) & (DENOMINATOR * np.minimum(n[a], n[y]) >= NUMERATOR * np.maximum(n[a], n[y])) & (~outer[y] | (key[a] < key[y]))
                b = y[fits & ((NUMERATOR + DENOMINATOR) * np.minimum(full[a], full[y]) >= NUMERATOR * (n[a] + n[y]))]
                b = b[np.bitwise_count(bits[b] ^ bits[a]).sum(1) <= MOST_BITS]
                if not len(b):
                    continue
                mine, others = np.frombuffer(own[a], np.uint64), np.concatenate([np.frombuffer(own[k], np.uint64) for k in b])
                met = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
                shared = np.add.reduceat(met.astype(np.int64), np.cumsum(n[b]) - n[b])
                b = b[DENOMINATOR * shared >= NUMERATOR * (n[a] + n[b] - shared)]
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[b], key[a])), pa.array(np.maximum(key[b], key[a]))], names=["a", "b"])

    return placed.repartition("main", "i", "j").sortWithinPartitions("main", "i", "j").mapInArrow(compare, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """``side, key, n, full, c, outside, odd, own`` of each run of rows with equal first three columns."""
    name, waiting = None, []
    for batch in batches:
        names = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 9)]
        columns.append(batch.column(9).flatten().to_numpy().view(np.uint64).reshape(len(names), -1))
        columns.append(np.array(batch.column(10).to_pylist(), object))
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if name is not None and tuple(names[a]) != name:
                yield [np.concatenate(c) for c in zip(*waiting, strict=True)]
                waiting = []
            name = tuple(names[a])
            waiting.append([c[a:b] for c in columns])
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting, strict=True)]


def near_components(rows: DataFrame) -> DataFrame:
    """``key, n, c`` of rows ``key, text`` with unique keys: set size, and the least key reachable by links."""
    spark = rows.sparkSession
    paths = [new_path(spark, f"odd-{name}") for name in ("sketches", "members")]
    table = stored(sketches(rows), paths[0])
    equal = table.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("key").alias("low"), F.count("*").alias("many")).where("many > 1").drop("many")
    folded = cut(table.select("key", "n", "f1", "f2").join(small_side(equal), ["n", "f1", "f2"]).where("low < key").select(F.col("low").alias("a"), F.col("key").alias("b")))
    single = table.where("n > 0").join(small_side(folded.select(F.col("b").alias("key"))), "key", "left_anti")

    placed = single.select(F.explode("bands").alias("bucket"), "key", "n")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    met = stored(placed.join(shared, "bucket"), paths[1])
    central = small_side(met.groupBy("key").agg(F.sum("many").alias("central")))
    members = met.select("bucket", "key", "n").join(central, "key")
    odd = single.join(small_side(central.select("key")), "key", "left_semi").select("key", "odd")

    def confirmed(pairs: DataFrame) -> DataFrame:
        found = verified(similar_bitmaps(pairs, odd), rows, document_sets)
        return cut(found.where(F.col("distance") <= 1 - NUMERATOR / DENOMINATOR + 1e-9).select("a", "b"))  # sizes below 10^8 can't fall in between

    edges = asked = None
    cells = spark.createDataFrame([], "key long, c long")
    while True:
        named = in_cells(members, cells)
        sizes = named.groupBy("bucket", "c").agg(F.count("*").alias("count")).groupBy("bucket")
        main = sizes.agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("cells")).where("cells > 1").drop("cells")
        state = cut(named.join(small_side(main), "bucket"))
        first = state if edges is None else state.where("c <> main")
        pivots = first.groupBy("bucket").agg(F.max(F.struct("central", -F.col("key"), F.col("key").alias("o"), F.col("n").alias("o_n"), F.col("c").alias("o_c"))).alias("p"))
        around = state.join(small_side(pivots.select("bucket", "p.o", "p.o_n", "p.o_c")), "bucket").where((F.col("c") != F.col("o_c")) & near_sizes("n", "o_n"))
        pairs = around.select(*pair("key", "o")).distinct()
        pairs = cut(pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti"))
        asked = pairs if asked is None else cut(asked.unionByName(pairs))
        more = confirmed(pairs)
        edges, done = more if edges is None else cut(edges.unionByName(more)), more.isEmpty()
        if done:
            break
        cells = small_side(components(edges).withColumnsRenamed({"node": "key", "component": "c"}))
    mixed = small_side(state.select("key").distinct())
    alone = small_side(alone_sizes(rows.join(mixed, "key", "left_semi")))
    full = (F.col("n") - F.col("alone")).alias("full")
    able = state.join(alone, "key").select("main", "key", "n", full, "c").where(DENOMINATOR * F.col("full") >= NUMERATOR * F.col("n"))
    regions = cut(able.distinct())
    busy = small_side(regions.where("c <> main").select("main").distinct())
    wanted = small_side(regions.join(busy, "main").select("key").distinct())
    with smaller_batches(spark, SET_ROWS):
        left = cut(_left_links(regions, odd, whole_sets(rows.join(wanted, "key", "left_semi"))))
    found = components(cut(edges.unionByName(left).unionByName(folded)))
    same = cut(table.select("key", "n"))
    for path in paths:
        forget(spark, path)
    return same.join(found.withColumnsRenamed({"node": "key", "component": "c"}), "key", "left").select("key", "n", F.coalesce("c", "key").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: the least id reachable by links, and whether the row is the one that stays.

    Two documents link when their sets of four-word shingles have a Jaccard similarity of at least 0.8. Words are runs of bytes other than ASCII white space,
    A-Z lower-cased; a shorter text's whole sequence is one shingle. Texts that are null or without words link with nothing and stay. Every row is a document of its
    own, also where rows repeat an id or have none; a component without any id has a null one, and one of its rows stays. Other columns are not
    read; an empty table gives an empty result. Equality of shingles is that of 64-bit hashes. A link at the threshold is missed with a probability below 1e-7; more similar sets with less.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, key = keyed(own, "doc_id", nulls_last=True)
    found = near_components(rows.select(F.col(key).alias("key"), "text"))
    kept = (F.col("key") == F.col("c")).alias("kept")
    if key == "doc_id":
        return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), kept)
    ids = rows.select(F.col(key).alias("key"), "doc_id")
    least = ids.select(F.col("key").alias("c"), F.col("doc_id").alias("component_id"))  # keys ascend with ids, nulls last
    return found.join(ids, "key").join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)
