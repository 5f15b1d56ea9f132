"""Packing of token sequences: Martello-Toth dominance reduction, then best fit for what it leaves.

Pieces are spread evenly over shards of a bounded number of narrow rows. Lengths are integers of at most ``capacity``,
so a shard's instance is a histogram: reduction and best fit treat all pieces of one length at once, in time that
depends on the number of lengths and not of pieces. A shard has at most one poorly filled sequence at its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare
from .tokens import encoder

CAPACITY = 2048
SHARD_PIECES = 1 << 14
END_ID = b"\0\0\0\0"
Pattern = tuple[tuple[int, int], ...]  #: (length, how often) in order of their place
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as ids with the end id 0; only longer documents are cut, into pieces of ``capacity`` ids."""
    prepare(docs.sparkSession)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + END_ID
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(encode_all, PIECES)


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sets of one or two pieces that dominate every other set with their longest piece; lowers ``counts``.

    Let r be the room beside a piece j and k the longest other piece within r. {j} dominates if nothing fits into r.
    {j, k} dominates if k fills r, if no two other pieces fit into r, or if no three fit and no two that fit are together
    longer than k: whatever else lies beside j could then swap places with k. An optimum with the fixed sets exists in
    each case, so nothing is lost.
    """
    fixed: list[tuple[Pattern, int]] = []
    lengths = np.arange(capacity + 1)
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                room, n = capacity - j, int(counts[j])
                counts[j] -= 1
                k = _longest(counts, room)
                small = _smallest(counts, 3)
                if not k:
                    counts[j] += 1
                    fixed.append((((j, 1),), n))
                    counts[j] = 0
                    changed = True
                    break
                dominates = k == room or len(small) < 2 or small[0] + small[1] > room
                if not dominates and (len(small) < 3 or sum(small) > room):
                    present = lengths[counts > 0]
                    first = present[present < room]
                    below = np.maximum.accumulate(np.where(counts > 0, lengths, 0))
                    second = below[room - first]
                    alone = (second == first) & (counts[first] < 2)
                    second[alone] = below[np.minimum(room - first[alone], first[alone] - 1)]
                    dominates = bool(not len(first) or (first + second)[second > 0].max(initial=0) <= k)
                counts[j] += 1
                if not dominates:
                    break
                if k == j:
                    times = n // 2
                    fixed.append((((j, 2),), times))
                    counts[j] -= 2 * times
                else:
                    times = min(n, int(counts[k])) if k == room or len(small) > 1 and small[0] + small[1] > room else 1
                    fixed.append((((j, 1), (k, 1)), times))
                    counts[j] -= times
                    counts[k] -= times
                changed = True
    return fixed


def _longest(counts: np.ndarray, room: int) -> int:
    found = np.flatnonzero(counts[: room + 1])
    return int(found[-1]) if len(found) else 0


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for length in np.flatnonzero(counts)[:n].tolist():
        out += [length] * min(int(counts[length]), n - len(out))
        if len(out) == n:
            break
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each piece into the fullest sequence with room for it; alike sequences are handled together."""
    open_by_room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(used[length:])
            room = length + int(rooms[0]) if len(rooms) else capacity
            pattern, many = open_by_room[room].pop() if len(rooms) else ((), left)
            each = min(room // length, left)
            full = min(many, left // each)
            if many > full and len(rooms):
                open_by_room[room].append((pattern, many - full))
            used[room] = bool(open_by_room[room])
            open_by_room[room - each * length].append(((*pattern, (length, each)), full))
            used[room - each * length] = True
            left -= full * each
    return [group for groups in open_by_room for group in groups]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of sequences and how often each is used; together they hold ``counts[length]`` pieces of each length."""
    rest = counts.astype(np.int64).copy()
    fixed = reduce_instance(rest, capacity)
    return fixed + best_fit(rest, capacity)


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and a place in it for each piece."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    at = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    first = 0
    for pattern, many in plan(counts, capacity):
        place = 0
        for length, each in pattern:
            rows = order[at[length] : at[length] + many * each]
            at[length] += many * each
            within = np.arange(many * each)
            sequence[rows] = first + within // each
            offset[rows] = place + within % each * length
            place += each * length
        first += many
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Null text counts as empty (the end id alone); null and repeated ids are kept as they are, each row being a document;
    other columns are not read; an empty table gives an empty result. A row's place, not its values, gives its shard, so equal rows spread. Ids are made once and the narrow pieces written to the
    shared folder; one shuffle of them forms the shards.
    """
    pieces = cut(pieces_of(docs, tokenizer, capacity, id_col, text_col))
    shards = max(1, round(pieces.count() / shard_pieces))
    names = [c.split()[0] for c in PACKED.split(", ")]

    def place(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        shard = shard.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = assign(shard.column("length").to_numpy(), capacity)
        out = shard.drop_columns(["shard"]).append_column("sequence_id", pa.array((number << 32) + sequence))
        return out.append_column("offset", pa.array(offset)).select(names)

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(place, PACKED)
