"""Readers and writers of alignment, distance and character files.

``register(spark)`` adds the formats ``fasta``, ``phylip``, ``distmat`` and ``binarymat`` to ``spark.read.format`` and ``write.format``. One file is one
alignment. Files are read in parallel, and large FASTA files, and PHYLIP files with a line for each taxon, by several tasks, each from the first record that begins in its
range of bytes. :func:`read` (a file a row) and :func:`read_fasta` (a record a row) go through Spark's own readers, so any store that Spark reads will do; the registered formats
read and write local and mounted paths, which all executors must share.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import workers_see_package

IUPAC = "ACGTUNXOMRWSYKVHDB?-."
#: Bits of A, C, G, T for each letter; a gap has none known.
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "X": 15, "O": 15, "?": 15, "-": 15, ".": 15}
AMINO = "ACDEFGHIKLMNPQRSTVWY"
SLICE_BYTES = 64 << 20  #: larger files of records are read by several tasks (option ``maxPartitionBytes``)


class FormatError(ValueError):
    """A file that doesn't follow its format; the message names the line."""


def fasta(text: str, protein: bool = False) -> list[tuple[str, str]]:
    """Names and sequences. Lines that start with ``#`` and blank lines are skipped, as are blanks and digits in sequences; a name is the first
    word. Unknown residues are X; an unknown base, an empty file and unequal lengths are errors."""
    rows: list[list[str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        if line[0] == ">":
            rows.append([(line[1:].split() or [""])[0], ""])
            continue
        if not rows:
            raise FormatError(f"line {number}: a sequence before any name")
        own = re.sub(r"[\s\d]", "", line).upper()
        if protein:
            own = re.sub(rf"[^{AMINO}\-]", "X", own)
        elif bad := re.search(rf"[^{re.escape(IUPAC)}]", own):
            raise FormatError(f"line {number}: no base: {bad[0]!r}")
        rows[-1][1] += own
    return _equal([(n, s) for n, s in rows])


def _equal(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    if not rows or not rows[0][1]:
        raise FormatError("no sequences")
    if len({len(s) for _, s in rows}) > 1:
        raise FormatError("sequences of unequal lengths")
    return rows


def phylip(text: str) -> list[tuple[str, str]]:
    """Sequential or interleaved sequences after a line with their number and length; names take ten characters."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        n, length = map(int, lines[0].split()[:2])
    except (ValueError, IndexError):
        raise FormatError("line 1: no number of taxa and sites") from None
    body = lines[1:]
    bases = lambda x: re.sub(r"[\s\d]", "", x).upper()
    if len(bases(body[0][10:])) < length and len(body) >= n and len(body) % n == 0 and len({len(bases(x[10:])) for x in body[:n]}) == 1 and len(body) > n:
        rows = [(body[k][:10].strip(), bases(body[k][10:]) + "".join(bases(body[b * n + k]) for b in range(1, len(body) // n))) for k in range(n)]
    else:
        rows, at = [], 0
        while at < len(body):
            name, own = body[at][:10].strip(), bases(body[at][10:])
            at += 1
            while len(own) < length and at < len(body):
                own += bases(body[at])
                at += 1
            rows.append((name, own))
    if len(rows) != n or any(len(s) != length for _, s in rows):
        raise FormatError(f"{n} sequences of {length} sites were announced")
    return rows


def distance_matrix(text: str) -> list[tuple[str, str, float]]:
    """``i, j, d`` (each pair once) of a square or lower-triangular matrix whose rows may be wrapped."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        n = int(lines[0].split()[0])
    except (ValueError, IndexError):
        raise FormatError("line 1: no number of taxa") from None
    names, rows = [], []
    for line in lines[1:]:
        head = re.match(r"\s*[-+.\d]", line)
        if not head or not rows:
            names.append(line[:10].strip())
            rows.append([])
            line = line[10:]
        try:
            rows[-1] += map(float, line.split())
        except ValueError:
            raise FormatError(f"no distances: {line.strip()[:20]!r}") from None
    if len(names) != n:
        raise FormatError(f"{n} taxa were announced")
    square = all(len(r) == n for r in rows)
    if not square and any(len(r) not in (k, k + 1) for k, r in enumerate(rows)):
        raise FormatError("neither a square nor a lower-triangular matrix")
    return [(names[j], names[i], rows[i][j]) for i in range(n) for j in range(i)]


def write_distances(rows: list[tuple[str, str, float]]) -> str:
    """A square matrix with ten-character names."""
    names = sorted({n for i, j, _ in rows for n in (i, j)})
    d = {(i, j): x for i, j, x in rows} | {(j, i): x for i, j, x in rows}
    return "\n".join([f"{len(names):5d}", *(f"{a[:10]:<10}" + "".join(f"{d.get((a, b), 0.0):10.6f}" for b in names) for a in names)]) + "\n"


def binary_matrix(text: str) -> list[tuple[str, str]]:
    """Names of ten characters and their 0/1 states, a line each."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        n, length = map(int, lines[0].split()[:2])
    except (ValueError, IndexError):
        raise FormatError("line 1: no number of taxa and characters") from None
    rows = [(x[:10].strip(), re.sub(r"\s", "", x[10:])) for x in lines[1:]]
    if len(rows) != n or any(len(s) != length or set(s) - {"0", "1"} for _, s in rows):
        raise FormatError(f"{n} rows of {length} states 0 or 1 were announced")
    return rows


def write_fasta(rows: list[tuple[str, str]]) -> str:
    """A name and lines of 60 residues for each sequence."""
    _equal(rows)
    return "".join(f">{n}\n" + "".join(f"{s[k : k + 60]}\n" for k in range(0, len(s), 60)) for n, s in rows)


def write_phylip(rows: list[tuple[str, str]]) -> str:
    """The number of taxa and sites, and a line for each taxon with its name in ten characters."""
    _equal(rows)
    if len({n[:10] for n, _ in rows}) < len(rows):
        raise FormatError("names that don't differ in their first ten characters")
    return f"{len(rows)} {len(rows[0][1])}\n" + "".join(f"{n[:10]:<10}{s}\n" for n, s in rows)


TEXTS: dict[str, Callable] = {"fasta": write_fasta, "phylip": write_phylip, "binarymat": write_phylip, "distmat": write_distances}
PARSERS: dict[str, tuple[str, Callable]] = {
    "fasta": ("aln_id string, taxon string, seq string", fasta),
    "phylip": ("aln_id string, taxon string, seq string", phylip),
    "binarymat": ("aln_id string, taxon string, seq string", binary_matrix),
    "distmat": ("aln_id string, i string, j string, d double", distance_matrix),
}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Rows of all files at a path that Spark can list, one task per file or more files."""
    workers_see_package(spark)
    schema, parser = PARSERS[kind]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(os.path.basename(name), *row) for row in parser(content.decode(), **options)]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=pa.schema([(n, pa.float64() if n == "d" else pa.string()) for n in names]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, schema)


def read_fasta(spark: SparkSession, path: str, protein: bool = False) -> DataFrame:
    """``aln_id, taxon, seq`` of FASTA files in any store that Spark reads, as :func:`fasta` gives them; a file of any size is read by as many tasks as it has splits.

    A row of Spark's text reader is a record here (its lines end where a name begins). Lengths are compared by one aggregation, before the rows are returned; bases are
    checked as rows are read. A file without sequences has no rows.
    """
    pieces = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("aln_id"), F.ltrim("value").alias("piece"))
    lines = F.transform(F.split("piece", "\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    first = F.regexp_replace(lines[0], "^>", "")
    own = F.upper(F.regexp_replace(F.array_join(F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.startswith("#")), ""), r"[\s\d]", ""))
    rows = pieces.where(F.size(kept) > 0).select("aln_id", F.coalesce(F.regexp_extract(F.trim(first), r"^(\S+)", 1), F.lit("")).alias("taxon"), own.alias("seq"))
    if protein:
        rows = rows.withColumn("seq", F.regexp_replace("seq", rf"[^{AMINO}\-]", "X"))
    else:
        bad = F.regexp_extract("seq", rf"([^{re.escape(IUPAC)}])", 1)
        said = F.raise_error(F.concat(F.col("aln_id"), F.lit(": no base: "), bad, F.lit(" in "), F.col("taxon"))).cast("string")
        rows = rows.withColumn("seq", F.when(bad != "", said).otherwise(F.col("seq")))
    size = F.length("seq")
    unequal = rows.groupBy("aln_id").agg(F.min(size).alias("low"), F.max(size).alias("high")).where("low <> high or low = 0").limit(1).collect()
    if unequal:
        raise FormatError(f"{unequal[0].aln_id}: sequences of unequal lengths, or a sequence before any name")
    return rows


def to_sites(sequences: DataFrame) -> DataFrame:
    """``aln_id, taxon, site, state``: one row per known base of sequence rows; ambiguous bases and gaps have none."""
    base = F.instr(F.lit("ACGT"), F.translate(F.col("base"), "U", "T")) - 1
    letters = sequences.select("aln_id", "taxon", F.posexplode(F.split("seq", "")).alias("site", "base")).where("base <> ''")
    return letters.select("aln_id", "taxon", "site", base.cast("int").alias("state")).where("state >= 0")


def to_masks(sequences: DataFrame) -> DataFrame:
    """``aln_id, taxon, site, mask``: the bases that each site may have, as bits of A, C, G, T; unknown sites and gaps, which may have any, have no row.

    Letters that stand for no base are unknown.
    """
    letters = F.create_map(*(F.lit(x) for pair in MASKS.items() for x in pair))
    at = sequences.select("aln_id", "taxon", F.posexplode(F.split(F.upper("seq"), "")).alias("site", "base")).where("base <> ''")
    return at.select("aln_id", "taxon", "site", F.try_element_at(letters, F.col("base")).cast("int").alias("mask")).where("mask < 15")


@dataclass
class Slice(InputPartition):
    """Those records of a file that begin in ``start:end``; all of it if ``end`` is negative."""

    path: str
    start: int = 0
    end: int = -1


def _split(path: str, kind: str, size: int, most: int) -> list[Slice]:
    if size <= most or kind not in ("fasta", "phylip") or (kind == "phylip" and not _lines_are_records(path)):
        return [Slice(path)]
    return [Slice(path, k, min(k + most, size)) for k in range(0, size, most)]


def _lines_are_records(path: str) -> bool:
    """Whether a PHYLIP file has each taxon on a line of its own: the first one holds as many sites as the header announces."""
    with open(path, "rb") as file:
        head, first = file.readline().split()[:2], file.readline()
    return len(head) == 2 and head[1].isdigit() and len(re.sub(rb"[\s\d]", b"", first[10:])) == int(head[1])


def _records(file: BinaryIO, start: int, end: int, begins: Callable[[bytes], bool]) -> Iterator[list[bytes]]:
    """Lines of each record whose first line begins in ``start:end``. A line that begins before ``start`` belongs to the slice before."""
    if start:
        file.seek(start - 1)
        file.readline()  # to the end of the line that holds the byte before
    record: list[bytes] = []
    while True:
        at, line = file.tell(), file.readline()
        if not line:
            break
        if begins(line):
            if record:
                yield record
            if at >= end:
                return
            record = [line]
        elif record:
            record.append(line)
        elif at >= end:
            return
        elif not start and line.strip() and line.lstrip()[:1] != b"#":
            raise FormatError("line 1: a sequence before any name")
    if record:
        yield record


def fasta_slice(file: BinaryIO, start: int, end: int, protein: bool = False) -> Iterator[tuple[str, str]]:
    """The sequences of a FASTA file whose names begin in ``start:end``. Each is as long as the file's first, which every slice reads."""
    named = lambda line: line.lstrip()[:1] == b">"
    first = next(_records(file, 0, 1 << 62, named), None)
    if first is None:
        raise FormatError("no sequences")
    length = len(fasta(b"".join(first).decode(), protein)[0][1])
    file.seek(0)
    for record in _records(file, start, end, named):
        name, own = fasta(b"".join(record).decode(), protein)[0]
        if len(own) != length:
            raise FormatError(f"sequences of unequal lengths: {name}")
        yield name, own


def phylip_slice(file: BinaryIO, start: int, end: int) -> Iterator[tuple[str, str]]:
    """The lines of a PHYLIP file, one for each taxon, that begin in ``start:end``; the slice with the header checks that as many follow as it announces."""
    n, length = map(int, file.readline().split()[:2])
    if not start:
        body = file.tell()
        if sum(1 for line in file if line.strip()) != n:
            raise FormatError(f"{n} sequences of {length} sites were announced")
        start = body
        file.seek(body)
    else:
        file.seek(start - 1)
        file.readline()
    while (at := file.tell()) < end and (line := file.readline()):
        if line.strip():
            own = re.sub(r"[\s\d]", "", line[10:].decode()).upper()
            if len(own) != length:
                raise FormatError(f"{n} sequences of {length} sites were announced; byte {at} has {len(own)}")
            yield line[:10].decode().strip(), own


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path = kind, options["path"]
        self.protein = options.get("alphabet") == "protein"
        self.most = int(options.get("maxpartitionbytes") or options.get("maxPartitionBytes") or SLICE_BYTES)

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [s for p in found if os.path.isfile(p) and os.path.basename(p)[0] not in "._" for s in _split(p, self.kind, os.path.getsize(p), self.most)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        options = {"protein": True} if self.kind == "fasta" and self.protein else {}
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as file:
            if partition.end < 0:
                rows = iter(PARSERS[self.kind][1](file.read().decode(), **options))
            elif self.kind == "fasta":
                rows = fasta_slice(file, partition.start, partition.end, **options)
            else:
                rows = phylip_slice(file, partition.start, partition.end)
            for row in rows:
                yield (name, *row)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished, as their names when they are in place and where they are now."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """A file for each alignment. Tasks write into a folder of their own kind; the commit moves all files, and a failed write leaves none.

    The rows of an alignment must be in one partition (see :func:`save`): an alignment that two tasks have is an error, and so is a file that exists, unless overwritten.
    """

    def __init__(self, kind: str, options: dict, columns: list[str], overwrite: bool) -> None:
        wanted = [c.split()[0] for c in PARSERS[kind][0].split(", ")]
        if sorted(columns) != sorted(wanted):
            raise FormatError(f"columns {', '.join(wanted)} are needed")
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite
        self.order = [columns.index(c) for c in wanted]
        self.made = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.made, exist_ok=True)
        found: dict[str, list[tuple]] = {}
        for row in iterator:
            own = tuple(row[k] for k in self.order)
            if not own[0] or os.path.basename(own[0]) != own[0] or own[0][0] in "._":
                raise FormatError(f"no name for a file: {own[0]!r}")
            found.setdefault(own[0], []).append(own[1:])
        files = []
        for name, rows in found.items():
            at = os.path.join(self.made, uuid.uuid4().hex)
            with open(at, "w") as file:
                file.write(TEXTS[self.kind](rows))
            files.append((name, at))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        twice = sorted({n for n, _ in files if sum(n == o for o, _ in files) > 1}) if len({n for n, _ in files}) < len(files) else []
        known = [] if self.overwrite else [n for n, _ in files if os.path.exists(os.path.join(self.path, n))]
        if twice or known:
            self.abort(messages)
            raise FormatError(f"more than one task has {twice[0]}" if twice else f"{known[0]} exists")
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in set(os.listdir(self.path)) - {n for n, _ in files}:
                if os.path.isfile(at := os.path.join(self.path, name)):
                    os.remove(at)
        for name, at in files:
            os.replace(at, os.path.join(self.path, name))
        shutil.rmtree(self.made, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.made, ignore_errors=True)


def save(rows: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Write a file for each ``aln_id`` in a registered format: its rows go to one partition first, in the order of their names."""
    order = ["aln_id", *(c for c in ("taxon", "i", "j") if c in rows.columns)]
    rows.repartition("aln_id").sortWithinPartitions(*order).write.format(kind).mode(mode).save(path)


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return PARSERS[kind][0]

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, self.options)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(kind, self.options, schema.names, overwrite)

    return Source


def register(spark: SparkSession) -> None:
    for kind in PARSERS:
        spark.dataSource.register(_source(kind))
