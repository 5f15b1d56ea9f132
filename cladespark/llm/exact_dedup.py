"""Exact deduplication by Grace hashing.

Digests are counted first, as equal texts have equal ones: a text whose digest occurs once is unique, and its content never moves.
Records of the other texts are folded twice: first inside each input partition, so that a text with any number of copies leaves at most
one record there, then, after one shuffle on the text's digest, over the whole table. Each fold puts records into an
open-addressing table that compares complete contents. A fold whose distinct contents outgrow its memory partitions
them and all later records into spill files by further digest bits, and folds each file in the same way. Spill files are a task's own: they
go with it, and a task that runs again makes them anew.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, cut, prepare, small_side

FANOUT_BITS = 4
SLOT_BYTES = 200
RECORD = pa.schema([("digest", pa.string()), ("content", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
Record = tuple[str, bytes, int | None, int]


class ContentTable:
    """Open addressing with linear probing. A slot is hit only by an equal complete content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.keys: list[int] = []
        self.records: list[list] = []
        self.bytes = 0

    def add(self, digest: str, content: bytes, doc_id: int | None, n: int) -> None:
        key = int(digest[:15], 16)
        mask = len(self.slots) - 1
        at = key & mask
        while (k := self.slots[at]) >= 0:
            record = self.records[k]
            if self.keys[k] == key and record[1] == content:
                record[3] += n
                if record[2] is None or (doc_id is not None and doc_id > record[2]):
                    record[2] = doc_id
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.keys)
        self.keys.append(key)
        self.records.append([digest, content, doc_id, n])
        self.bytes += len(content) + SLOT_BYTES
        if 5 * len(self.keys) > 3 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, key in enumerate(self.keys):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


class _Spill:
    """Files of one level of the partitioning, one for each value of the next digest bits."""

    def __init__(self, folder: str, depth: int) -> None:
        self.depth = depth
        self.paths = [f"{folder}/{depth}-{os.urandom(6).hex()}-{k}.arrow" for k in range(1 << FANOUT_BITS)]
        self.writers: list = [None] * len(self.paths)
        self.waiting: list[list[Record]] = [[] for _ in self.paths]
        self.size = [0] * len(self.paths)

    def add(self, record: Record) -> None:
        k = int(record[0][-1 - self.depth], 16)
        self.waiting[k].append(record)
        self.size[k] += len(record[1]) + SLOT_BYTES
        if self.size[k] > 1 << 20:
            self._flush(k)

    def _flush(self, k: int) -> None:
        if self.writers[k] is None:
            self.writers[k] = pa.ipc.new_stream(self.paths[k], RECORD)
        self.writers[k].write_batch(_batch(self.waiting[k]))
        self.waiting[k], self.size[k] = [], 0

    def close(self) -> list[str]:
        for k, rows in enumerate(self.waiting):
            if rows:
                self._flush(k)
        for writer in self.writers:
            if writer is not None:
                writer.close()
        return [p for p, w in zip(self.paths, self.writers, strict=True) if w is not None]


def _batch(records: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], RECORD.field(k).type) for k in range(4)], schema=RECORD)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def grace_fold(records: Iterable[Record], memory_bytes: int, folder: str, depth: int = 0) -> Iterator[list]:
    """One record for each distinct content: its largest id and the sum of its counts.

    Beyond the last digest bits no file is split again (contents with an equal digest); such a bucket stays in memory.
    """
    table, spill = ContentTable(), None
    for record in records:
        if spill is not None:
            spill.add(record)
            continue
        table.add(*record)
        if table.bytes > memory_bytes and depth < 32:
            spill = _Spill(folder, depth)
            for kept in table.records:
                spill.add(tuple(kept))
            table = ContentTable()
    yield from table.records
    if spill is not None:
        for path in spill.close():
            with pa.ipc.open_stream(path) as stream:
                yield from grace_fold(_records(stream), memory_bytes, folder, depth + 1)
            os.remove(path)


def _fold(memory_bytes: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            folder = stack.enter_context(tempfile.TemporaryDirectory(prefix="grace-"))
            waiting, size = [], 0
            for record in grace_fold(_records(batches), memory_bytes, folder):
                waiting.append(record)
                size += len(record[1])
                if size > 4 << 20:
                    yield _batch(waiting)
                    waiting, size = [], 0
            if waiting:
                yield _batch(waiting)

    return fold


def _counted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``digest, id, content`` of all rows, and ``digest, id, n`` of all digests (largest id, number of rows)."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), F.col(id_col).cast("long").alias("id"), F.encode(content, "UTF-8").alias("content"))
    return records, cut(records.groupBy("digest").agg(F.max("id").alias("id"), F.count("*").alias("n")))


def _repeated(records: DataFrame, counted: DataFrame, memory_bytes: int) -> DataFrame:
    """``digest, id, n`` of texts that occur more than once, by their complete contents."""
    prepare(records.sparkSession)
    hashed = F.xxhash64("digest").alias("hashed")  # others that share a hash are only folded for nothing
    wanted = small_side(counted.where("n > 1").select(hashed).distinct())
    chosen = records.withColumn("hashed", hashed).join(wanted, "hashed", "left_semi")
    kind = "digest string, content binary, id long, n long"
    local = chosen.select(F.lower(F.hex("digest")).alias("digest"), "content", "id", F.lit(1).cast("long").alias("n")).mapInArrow(_fold(memory_bytes), kind)
    groups = local.repartition("digest").mapInArrow(_fold(memory_bytes), kind)
    return groups.where("n > 1").select(F.unhex("digest").alias("digest"), "id", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 32 << 20) -> DataFrame:
    """One row per distinct text: ``text_sha256, keep_id`` (its largest id), ``group_size``."""
    records, counted = _counted(docs, id_col, text_col)
    groups = counted.where("n = 1").unionByName(_repeated(records, counted, memory_bytes))
    return groups.select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 32 << 20) -> DataFrame:
    """Every row's group of identical texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Of equal texts the row with the largest id stays; rows that repeat both id and text are
    one document and share its verdict; a null id loses to any other, and ``kept`` is null-safe. Other columns are
    not read. An empty table gives an empty result. Repeated texts are joined back by their digest, in a broadcast while they are few (counted);
    beyond that a group that holds a large share of the rows is split by adaptive execution, as its other side is one row.
    """
    records, counted = _counted(docs, id_col, text_col)
    groups = small_side(_repeated(records, counted, memory_bytes).withColumnsRenamed({"id": "keep", "n": "many"}), BROADCAST_ROWS // 4)
    joined = records.select("digest", "id").join(groups, "digest", "left")
    keep = F.when(F.col("many").isNull(), F.col("id")).otherwise(F.col("keep"))
    size = F.coalesce("many", F.lit(1)).cast("long")
    return joined.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
