"""Fuzzy line deduplication by MinHash.

Lines that are equal after trimming and lower-casing are one; one pass over the texts writes each partition's different lines with the bands of
their signatures. A line's set of character shingles gets a one-permutation MinHash signature, densified by rotation, whose bands form buckets.
Links are pairs of a bucket whose shingle sets have the threshold's Jaccard similarity, computed exactly from the lines. They are looked for up to connectivity:
first each line is compared with its bucket's first line and with its predecessor. Buckets whose lines are then in different components go
on as regions (module ``cells``): lines outside the main component, around pivots of their own, and at last every pair of different components
that windows leave, block by block inside tasks. The window that matters in families of templates counts a line's shingles that no other line of such buckets has: they can't be shared.
So no link between components is missed, and pairs in one component aren't listed. Connected components are found on the distributed edges,
and of each component the occurrence with the least document id and line number stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import DENOMINATOR, NUMERATOR, cells_of, close, in_cells, links, whole_regions
from .components import components
from .runtime import BROADCAST_ROWS, counted, cut, dealt, few_files, forget, keyed, new_path, packed, prepare, small_side, stored, tidy
from .words import mix, power_tables

SHINGLE = 8
BANDS, ROWS = 12, 4
BLOCK_LINES, BLOCK_CHARS = 256, 1 << 17  #: most lines and characters of a block, on average
FEW_LINES, AT_ONCE = 16, 1 << 17  #: groups of at most so many lines are compared many at a time, up to so many characters
COLUMNS = 1 << 12  #: shingles whose lines are multiplied at a time
SEEN_LINES = 1 << 20  #: keys of lines that a task remembers; beyond them it starts again, and lines may be written twice
_BINS = BANDS * ROWS
_VALUE_BITS = 40
_EMPTY = np.uint64(1) << np.uint64(63)
_MULTIPLIER = 0x9E3779B97F4A7C15

SCANNED = "is_line boolean, id long, keys array<long>, line string"


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def key_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


_CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _codes(points: np.ndarray) -> np.ndarray:
    """A hash of each code point."""
    if len(points) and int(points.max()) >= len(_CODES):
        return mix(points.astype(np.uint64) + np.uint64(1))
    return _CODES[points]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines' character shingles, and the line of each; a line of fewer characters is one shingle."""
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    power, inverse = power_tables(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_codes(points) * power[: len(points)], out=total[1:])
    n = max(0, len(points) - SHINGLE + 1)
    whole = np.ones(n, bool)  # windows that don't reach over a line's end
    for k in range(1, SHINGLE):
        over = ends[:-1] - k
        whole[over[(over >= 0) & (over < n)]] = False
    hashes = ((total[SHINGLE : SHINGLE + n] - total[:n]) * inverse[:n])[whole]
    row = np.repeat(np.arange(len(lines)), np.maximum(lengths - SHINGLE + 1, 0))
    short = np.flatnonzero(lengths < SHINGLE)
    if len(short):
        first = ends[short] - lengths[short]
        hashes = np.concatenate([hashes, (total[ends[short]] - total[first]) * inverse[first]])
        row = np.concatenate([row, short])
    return mix(hashes), row


def signatures(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS * ROWS`` values for each line."""
    hashes, row = shingle_hashes(lines)
    cell = row.astype(np.uint64) * np.uint64(_BINS) + ((hashes >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32))
    ordered = np.sort((cell << np.uint64(_VALUE_BITS)) | (mix(hashes) >> np.uint64(64 - _VALUE_BITS)))
    cells = ordered >> np.uint64(_VALUE_BITS)
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    out = np.full(len(lines) * _BINS, _EMPTY)
    out[cells[first]] = ordered[first] & np.uint64((1 << _VALUE_BITS) - 1)
    out = out.reshape(len(lines), _BINS)
    filled, step = out.copy(), 1
    while (empty := filled == _EMPTY).any():
        moved = np.roll(out, -step, axis=1)
        filled = np.where(empty & (moved != _EMPTY), moved + np.uint64(step << _VALUE_BITS), filled)
        step += 1
    return filled


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS`` 64-bit keys for each line."""
    own = signatures(lines).reshape(len(lines), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), BANDS)).copy()
    for k in range(ROWS):
        total = mix(total * np.uint64(_MULTIPLIER) + own[:, :, k])
    return total.view(np.int64)


def _distinct(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's different shingles, as hashes that hold the line too, sorted, and the line of each."""
    own = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    own = own[order]
    fresh = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, bool)
    return own[fresh], row[order[fresh]]


def shared_shingles(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the shingle sets of each pair of lines, and of their intersection, for many pairs at a time."""
    (x, row_x), (y, row_y) = _distinct(*shingle_hashes(a)), _distinct(*shingle_hashes(b))
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    return tuple(np.bincount(r, minlength=len(a)) for r in (row_x, row_y, row_x[y[at] == x]))


def similarity(a: str, b: str) -> float:
    n, m, k = (int(v[0]) for v in shared_shingles([a], [b]))
    return k / (n + m - k)


def _portions(sizes: list[int], most: int = 1 << 19) -> Iterator[slice]:
    """Ranges of rows with a bounded number of characters, or one row."""
    first = size = 0
    for k, own in enumerate(sizes):
        if k > first and size + own > most:
            yield slice(first, k)
            first, size = k, 0
        size += own
    if first < len(sizes):
        yield slice(first, len(sizes))


def _scanned(rows: DataFrame) -> DataFrame:
    """Of each row the keys of its lines (null: blank), and of each line not met before in the task its bands."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.string())
        names = [c.split()[0] for c in SCANNED.split(", ")]
        for batch in batches:
            docs, found, lines = [], [], []
            for text in batch.column(1).to_pylist():
                own = []
                for line in text.split("\n"):
                    line = normal(line)
                    own.append(key := key_of(line) if line else None)
                    if line and key not in seen:
                        seen.add(key)
                        found.append(key)
                        lines.append(line)
                docs.append(own)
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([False] * n), batch.column(0), pa.array(docs, kinds[2]), pa.nulls(n, kinds[3])], names=names)
            for part in _portions([len(x) for x in lines]):
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(lines[part]).ravel()), BANDS).cast(kinds[2])
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays([pa.array([True] * n), pa.array(found[part], kinds[1]), bands, pa.array(lines[part], kinds[3])], names=names)
            if len(seen) > SEEN_LINES:
                seen.clear()

    return rows.mapInArrow(make, SCANNED)


def _buckets(bands: DataFrame) -> DataFrame:
    """``band, key, first, before`` of buckets with at least two lines: each line's key, the bucket's first and the one before. ``bands``: ``band, key``."""
    names = ["band", "key", "first", "before"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, key), _, _ in whole_regions(batches):
            fresh = np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
            band, key = band[fresh], key[fresh]
            first = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            many = np.diff(np.append(first, len(band)))
            head = np.repeat(first, many)
            keep = np.repeat(many > 1, many)
            before = key[np.maximum(np.arange(len(key)) - 1, head)]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (band, key, key[head], before)], names=names)

    return bands.repartition("band").sortWithinPartitions("band", "key").mapInArrow(make, ", ".join(f"{c} long" for c in names))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, na, nb, linked``: sizes of the shingle sets of pairs of lines, and whether they have the threshold's similarity."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for part in _portions([len(p) + len(q) for p, q in zip(x, y, strict=True)]):
                n, m, k = shared_shingles(x[part], y[part])
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n), pa.array(m), pa.array(links(n, m, k))], names=["a", "b", "na", "nb", "linked"])

    return both.mapInArrow(compare, "a long, b long, na long, nb long, linked boolean")


def _own_shingles(texts: DataFrame) -> DataFrame:
    """``key, own``: how many shingles of a line no other line of ``texts`` has (without those it has twice)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in _portions([len(x) for x in lines]):
                hashes, row = shingle_hashes(lines[part])
                hashes, at, many = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[part][row[at]]), pa.array(many == 1)], names=["shingle", "key", "alone"])

    made = texts.select("key", "line").mapInArrow(make, "shingle long, key long, alone boolean")
    single = made.groupBy("shingle").agg(F.count("*").alias("many"), F.min("key").alias("key"), F.min("alone").alias("alone")).where("many = 1 and alone")
    return single.groupBy("key").agg(F.count("*").alias("own"))


def _between(lines: list[str], cells: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A linked pair of lines for each two cells that have one; if both blocks have lines, of different blocks. ``low``: whether a line is of the lower block."""
    hashes, row = shingle_hashes(lines)
    _, shingle = np.unique(hashes, return_inverse=True)
    both = np.unique(shingle.astype(np.int64) * len(lines) + row)
    shingle, row = both // len(lines), both % len(lines)
    sizes = np.bincount(row, minlength=len(lines))
    x, y = np.flatnonzero(low), np.flatnonzero(~low)
    if len(y):
        here, there = (np.bincount(shingle[low[row] == side], minlength=int(shingle[-1]) + 1) > 0 for side in (True, False))
        kept = (here & there)[shingle]
    else:
        y, kept = x, np.bincount(shingle)[shingle] > 1
    shingle, row = shingle[kept], row[kept]
    shingle = np.cumsum(np.diff(shingle, prepend=shingle[:1]) > 0)
    shared = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, COLUMNS):
        part = slice(*np.searchsorted(shingle, (first, first + COLUMNS)))
        table = np.zeros((len(lines), int(shingle[part.stop - 1]) + 1 - first), np.float32)
        table[row[part], shingle[part] - first] = 1
        shared += table[x] @ table[y].T
    at, to = np.nonzero(links(sizes[x][:, None], sizes[y][None, :], shared.astype(np.int64)) & (cells[x][:, None] != cells[y][None, :]))
    x, y = x[at], y[to]
    _, fresh = np.unique(np.sort(np.stack([cells[x], cells[y]], 1), 1), axis=0, return_index=True)
    return x[fresh], y[fresh]


def _between_few(lines: list[str], many: list[int], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of lines of different cells of one group, for groups of ``many`` lines each: all groups' pairs together."""
    hashes, row = shingle_hashes(lines)
    mark = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mark)
    mark = mark[order]
    fresh = np.concatenate(([True], mark[1:] != mark[:-1]))
    mark, order = mark[fresh], order[fresh]
    order = order[np.argsort(row[order], kind="stable")]
    hashes, sizes = hashes[order], np.bincount(row[order], minlength=len(lines))
    starts, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(many)), many)
    pairs, step, live = [], 1, np.arange(len(lines))
    while len(live := live[live + step < len(lines)]) and len(live := live[group[live] == group[live + step]]):
        x, y = live, live + step
        fits = (cells[x] != cells[y]) & (DENOMINATOR * np.minimum(sizes[x], sizes[y]) >= NUMERATOR * np.maximum(sizes[x], sizes[y]))
        pairs.append(np.stack([x[fits], y[fits]]))
        step += 1
    x, y = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
    x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
    linked = np.zeros(len(x), bool)
    for part in _portions(sizes[x].tolist()):
        n = sizes[x[part]]
        owner = np.repeat(np.arange(len(n)), n)
        asked = hashes[np.arange(int(n.sum())) + np.repeat(starts[x[part]] - np.cumsum(n) + n, n)] ^ mix(y[part].astype(np.uint64) + np.uint64(1))[owner]
        asked = mix(asked)
        found = mark[np.minimum(np.searchsorted(mark, asked), len(mark) - 1)] == asked
        linked[part] = links(n, sizes[y[part]], np.bincount(owner[found], minlength=len(n)))
    return x[linked], y[linked]


def _linked_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Linked pairs ``a, b`` of lines of a region that are in different cells, enough to connect these. ``members``: ``region, key, c``.

    A region is cut into blocks of bounded numbers of lines and characters; each two blocks, and each one, are a group of rows whose lines are compared inside a task. So no
    pair is a row: a line is sent as often as its region has blocks. Of regions with equal lines one is compared.
    """
    own = members.select("region", "key", "c").join(texts, "key")
    sizes = own.groupBy("region").agg(F.count("*").alias("many"), F.sum(F.length("line").cast("long")).alias("chars"), F.min("c").alias("low"), F.max("c").alias("high"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"mark{k}") for k in (1, 2)))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_LINES), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    cut_up = small_side(sizes.where("low < high").groupBy("many", "mark1", "mark2").agg(F.min("region").alias("region"), F.first(blocks).alias("blocks")).select("region", "blocks"))
    own = own.join(cut_up, "region").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    placed = sent.select(group.alias("group"), "key", "c", (F.col("block") <= F.col("other")).alias("low"), "line").repartition("group").sortWithinPartitions("group")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: list[tuple], few: list[int] | None = None) -> pa.RecordBatch:
            _, keys, cells, low, lines = zip(*rows, strict=True)
            keys, cells, low = np.array(keys), np.array(cells), np.array(low)
            if few:
                x, y = _between_few(list(lines), few, cells)
            else:
                x, y = _between(list(lines), cells, low) if (cells != cells[0]).any() else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[x], keys[y])), pa.array(np.maximum(keys[x], keys[y]))], names=["a", "b"])

        def groups() -> Iterator[list[tuple]]:
            current, rows = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[0] != current and rows:
                        yield rows
                        rows = []
                    current = row[0]
                    rows.append(row)
            if rows:
                yield rows

        waiting, many, chars = [], [], 0
        for rows in groups():
            if len(rows) > FEW_LINES or not all(r[3] for r in rows):
                yield met(rows)
                continue
            waiting += rows
            many.append(len(rows))
            chars += sum(len(r[4]) for r in rows)
            if chars > AT_ONCE:
                yield met(waiting, many)
                waiting, many, chars = [], [], 0
        if waiting:
            yield met(waiting, many)

    return placed.mapInArrow(compare, "a long, b long")


def line_links(scanned: DataFrame) -> DataFrame:
    """Edges ``a, b`` between keys of lines whose components are those of all links. ``scanned``: what one pass wrote."""
    lines = scanned.where("is_line")
    buckets = cut(_buckets(lines.select(F.explode("keys").alias("band"), F.col("id").alias("key"))))
    tidy(lines.sparkSession)
    ask = buckets.select("key", F.explode(F.array("first", "before")).alias("other")).where("key <> other")
    ask = cut(few_files(ask.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()))
    wanted = small_side(buckets.select("key").distinct())
    texts = cut(lines.select(F.col("id").alias("key"), "line").join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    many = counted(ask)
    tidy(lines.sparkSession)
    met = dealt(cut(_compared(dealt(ask, many), texts)), many)
    tidy(lines.sparkSession)
    edges = packed(met.where("linked").select("a", "b"))
    cells = cells_of(edges)

    named = in_cells(buckets.select("band", "key"), cells)
    mixed = small_side(named.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band"))
    members = packed(buckets.select("band", "key").join(mixed, "band", "left_semi"))
    if members.isEmpty():
        return edges
    sizes = met.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("na").alias("n")), F.struct(F.col("b").alias("key"), F.col("nb").alias("n")))).alias("s")).select("s.*").dropDuplicates(["key"])
    keys = small_side(members.select("key").distinct())
    own = _own_shingles(texts.join(keys, "key", "left_semi"))
    known = small_side(keys.join(sizes, "key").join(own, "key", "left").select("key", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("full")))
    placed = packed(members.join(known, "key").select(F.col("band").alias("region"), "key", "n", "full", F.lit(None).cast("double").alias("d")))

    def linked(pairs: DataFrame) -> DataFrame:
        return _compared(pairs, texts).where("linked").select("a", "b")

    edges, left = close(placed, edges, cells, linked, pairs=False)
    tidy(lines.sparkSession)
    return cut(edges.unionByName(_linked_in_blocks(left, texts)))


def dropped_lines(rows: DataFrame, key: str) -> DataFrame:
    """``doc, line, group`` of every line that goes. ``rows``: ``key`` (unique) and ``text``."""
    spark = rows.sparkSession
    prepare(spark)
    path = new_path(spark, "lines")
    scanned = stored(_scanned(rows.select(key, "text")), path)
    found = components(line_links(scanned)).withColumnsRenamed({"node": "key", "component": "c"})
    occurrences = scanned.where("not is_line").select(F.col("id").alias("doc"), F.posexplode("keys").alias("line", "key")).where("key is not null")
    firsts = occurrences.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    groups = cut(firsts.join(found, "key", "left").where("n > 1 or c is not null").select("key", F.coalesce("c", "key").alias("group"), "first"))
    winners = groups.groupBy("group").agg(F.min("first").alias("winner"))
    known = small_side(groups.join(winners, "group").select("key", "group", "winner"))
    tidy(spark)
    out = cut(occurrences.join(known, "key").where(F.struct("doc", "line") != F.col("winner")).select("doc", "line", "group"))
    forget(spark, path)
    tidy(spark)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row.

    Lines end at line feeds. Blank lines stay and aren't compared. Null text counts as empty (one blank line). Every row is a document of its own, also where
    rows repeat an id or have none; null ids come after all others, so their lines go first. An empty table gives an empty result; other columns
    are not read. Equality of shingles is that of 64-bit hashes; only links of pairs that share a band of their signatures are found.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, key = keyed(own, "doc_id", nulls_last=True)
    gone = dropped_lines(rows, key)
    few = counted(gone) <= BROADCAST_ROWS
    gone = gone.groupBy("doc").agg(F.collect_list("line").alias("gone"))
    joined = rows.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("doc"), "left").select("doc_id", "text", "gone")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, places = text.split("\n"), set(places or ())
                out.append((len(lines), len(places), "\n".join(x for k, x in enumerate(lines) if k not in places) if places else text))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept_text string")
