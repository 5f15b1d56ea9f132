"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file: data frames, each with the ids of some whole documents as little-endian unsigned 32-bit integers; a
skippable frame with the document index (zstandard-compressed: doc ids, token counts and frame numbers, of a null id the number's complement); a skippable frame with the seek
table of the public seekable zstandard format: compressed size, decompressed size and checksum (low 32 bits of XXH64 of
the ids) of each data frame, then the footer. Any zstandard decoder reads the whole; :class:`TokenFile` reads only the frames of the documents
that are asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import new_path, prepare, qualified
from .tokens import encoder

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
HEADER = struct.Struct("<II")

FRAME_BYTES = 256 << 10
END_ID = b"\0\0\0\0"


class TokenFileWriter:
    """Appends documents to an open binary sink; ``close`` writes the index and the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        frame = len(self.frames)
        self.index.append((0, len(ids) // 4, ~frame) if doc_id is None else (doc_id, len(ids) // 4, frame))
        self.pending.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4

    def _flush(self) -> None:
        data = b"".join(self.pending)
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        columns = np.array(self.index, np.int64).reshape(-1, 3)
        packed = self.compressor.compress(columns.T.astype("<i8").tobytes())
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(HEADER.pack(SKIPPABLE_INDEX, len(packed)) + packed)
        self.sink.write(HEADER.pack(SKIPPABLE_SEEK, len(table)) + table)


class TokenFile:
    """Reads documents of a file; ``source`` is a seekable binary file."""

    def __init__(self, source) -> None:
        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        count, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(end - FOOTER.size - count * ENTRY.size)
        self.frames = np.frombuffer(source.read(count * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        source.seek(int(self.offsets[-1]))
        magic, size = HEADER.unpack(source.read(HEADER.size))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index before the seek table")
        index = np.frombuffer(self.decompressor.decompress(source.read(size)), "<i8").reshape(3, -1)
        self.doc_ids, self.counts, frame = index
        self.null = frame < 0
        self.frame_of = np.where(self.null, ~frame, frame)

    def rows(self, wanted: Iterable[int] | None) -> np.ndarray:
        """Numbers of the wanted documents (all: None)."""
        return np.arange(len(self.doc_ids)) if wanted is None else np.flatnonzero(np.isin(self.doc_ids, list(wanted)) & ~self.null)

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.offsets[k]))
        data = self.decompressor.decompress(self.source.read(int(self.frames[k, 0])))
        if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """Ids of the wanted documents (all: None), in file order; other documents' frames are not read."""
        open_frame, data, starts = -1, b"", {}
        for row in self.rows(wanted).tolist():
            k = int(self.frame_of[row])
            if k != open_frame:
                open_frame, data = k, self.frame(k)
                own = np.flatnonzero(self.frame_of == k) if wanted is not None else np.arange(np.searchsorted(self.frame_of, k), np.searchsorted(self.frame_of, k, "right"))
                starts = dict(zip(own.tolist(), np.concatenate(([0], np.cumsum(self.counts[own])[:-1])).tolist(), strict=True))
            yield None if self.null[row] else int(self.doc_ids[row]), np.frombuffer(data, "<u4", int(self.counts[row]), 4 * starts[int(row)])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode every whole text (null: empty), add the end id 0, and write the files in ascending id order.

    One range-partitioned sort moves the texts; each task writes one file. Returns the manifest in id order, with
    ``first`` (ids in the files before); it has a row, and a partition, for each file, not for each document. A task that runs again
    writes a new file, and only files in the manifest count.
    """
    spark = docs.sparkSession
    prepare(spark)
    uri = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        filesystem, base = _store(uri)
        writer = sink = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    filesystem.create_dir(base, recursive=True)
                    path = f"{base}/part-{part:05d}-{uuid.uuid4().hex}.zst"
                    sink = filesystem.open_output_stream(path, compression=None)
                    writer = TokenFileWriter(sink, frame_bytes)
                writer.add(doc_id, encode(text) + END_ID)
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{uri}/{path.rsplit('/', 1)[1]}"], "n_docs": [len(writer.index)], "n_tokens": [writer.tokens], "n_bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    made = sorted(placed.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.part)
    first, out = 0, []
    for row in made:
        out.append((*row, first))
        first += row.n_tokens
    return spark.createDataFrame(out, f"{MANIFEST}, first long").repartition(max(1, len(out)))


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of the files' documents (of all, or of the wanted ids)."""
    prepare(manifest.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, name = _store(path)
                with filesystem.open_input_file(name) as source:
                    file = TokenFile(source)
                    begin = dict(zip(range(len(file.counts)), (first + np.concatenate(([0], np.cumsum(file.counts)[:-1]))).tolist(), strict=True))
                    keep = file.rows(wanted).tolist()
                    rows, size = [], 0
                    for row, (doc_id, ids) in zip(keep, file.documents(wanted), strict=True):
                        rows.append((doc_id, begin[row], ids.tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    return manifest.select("path", "first").mapInArrow(load, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def token_digests(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what :func:`read_tokens` gives."""

    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_store(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents' ids, read the files back, and return ``doc_id, start, n_tokens, ids_crc32`` per document.

    Null text counts as empty (one id, the end id). Null ids come first and stay null; rows with equal ids follow one another in text order; other
    columns are not read; an empty table writes no file and gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    manifest = write_tokens(docs, folder or new_path(spark, "tokens"), tokenizer)
    return token_digests(read_tokens(manifest))


