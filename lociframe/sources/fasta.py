"""Indexed FASTA files as a Spark data source: ``spark.read.format("fasta").load(path)`` after ``register(spark)``.

Rows are chunks of ``chunkBases`` bases: ``file, contig, chunk_no, chunk_start, bases``. The index beside each file (``.fai``)
turns a chunk into the range of bytes between its first and last base, so only what is asked for is read, and one contig
is read by many tasks. Filters on ``contig`` and ``chunk_no``, or an option ``regions`` (``chr1:5-90;chr2:7-9``), leave only
their chunks. With option ``header`` the rows are the contigs of each file's index.

Paths go through ``files.resolve``. ``write.format("fasta")`` writes ``contig, bases``, a file and an index for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lociframe.operators.reads import CHUNK
from lociframe.sources import files
from lociframe.sources.regions import parse_regions, windows_of

CHUNKS = "file string, contig string, chunk_no long, chunk_start long, bases string"
CONTIGS = "file string, name string, length long"
ENDINGS = (".fa", ".fasta", ".fna")
BATCH_BASES = 1 << 22


@dataclass(frozen=True)
class Entry:
    """A contig in an index: where its first base is, and the bases and bytes of its lines."""

    name: str
    length: int
    offset: int
    line_bases: int
    line_bytes: int

    def byte(self, base: int) -> int:
        """Of a base, counted from 0."""
        return self.offset + base // self.line_bases * self.line_bytes + base % self.line_bases


def read_index(path: str) -> list[Entry]:
    lines = files.whole(path).decode().splitlines()
    return [Entry(f[0], *map(int, f[1:5])) for f in (x.split("\t") for x in lines if x)]


@dataclass
class Runs(InputPartition):
    path: str
    runs: list[tuple[Entry, int, int]]  # a contig's chunks from the first to before the last


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        self.paths = [p for e in ENDINGS for p in files.listed(lower["path"], e)] if not lower["path"].endswith(ENDINGS) else files.listed(lower["path"], "")
        if not self.paths:
            raise FileNotFoundError(lower["path"])
        self.header = lower.get("header", "false").lower() == "true"
        self.size = int(lower.get("chunkbases", CHUNK))
        self.per_task = max(1, int(lower.get("rangebytes", 32 << 20)) // self.size)
        self.page = int(lower.get("pagebytes", 1 << 20))
        self.regions = parse_regions(lower["regions"]) if "regions" in lower else None
        self.contigs: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "contig" and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = named if self.contigs is None else self.contigs & named
            if name == "chunk_no" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if name == "chunk_no" and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                bound = f.value - isinstance(f, LessThan)
                self.high = bound if self.high is None else min(self.high, bound)
            yield f

    def _runs(self, entry: Entry) -> list[tuple[int, int]]:
        """The chunks wanted of a contig, as runs."""
        n = -(-entry.length // self.size)
        if self.contigs is not None and entry.name not in self.contigs:
            return []
        spans = [(0, n)] if self.regions is None else [((low - 1) // self.size, n if high is None else (high - 1) // self.size + 1) for name, low, high in self.regions if name == entry.name]
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            a, b = max(a, self.low), min(b, n, n if self.high is None else self.high + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            elif a < b:
                out.append((a, b))
        return out

    def partitions(self) -> list[Runs]:
        out: list[Runs] = []
        for path in self.paths:
            if self.header:
                out.append(Runs(path, []))
                continue
            room = 0
            for entry in read_index(f"{path}.fai"):
                for a, b in self._runs(entry):
                    while a < b:
                        if not room:
                            out.append(Runs(path, []))
                            room = self.per_task
                        n = min(room, b - a)
                        out[-1].runs.append((entry, a, a + n))
                        a, room = a + n, room - n
        return out

    def read(self, partition: Runs | None) -> Iterator[pa.RecordBatch | tuple]:
        if partition is None:
            return
        if self.header:
            yield from ((partition.path, e.name, e.length) for e in read_index(f"{partition.path}.fai"))
            return
        with files.Pages(partition.path, self.page) as f:
            rows: list[tuple[str, int, str]] = []
            for entry, first, last in partition.runs:
                for k in range(first, last):
                    start, end = k * self.size, min(entry.length, (k + 1) * self.size)
                    at = entry.byte(start)
                    bases = f.read(at, entry.byte(end - 1) + 1 - at).translate(None, b"\r\n")
                    if len(bases) != end - start:
                        raise ValueError(f"{partition.path} doesn't fit its index at {entry.name}:{start + 1}-{end}")
                    rows.append((entry.name, k, bases.decode()))
                    if len(rows) * self.size >= BATCH_BASES:
                        yield self._batch(partition.path, rows)
                        rows = []
            if rows:
                yield self._batch(partition.path, rows)

    def _batch(self, path: str, rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        names, numbers, bases = zip(*rows, strict=True)
        starts = [k * self.size + 1 for k in numbers]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(names), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(bases)], ["file", "contig", "chunk_no", "chunk_start", "bases"])


class FastaWriter(files.PartsWriter):
    def __init__(self, options: dict[str, str]) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        super().__init__(lower["path"])
        self.line = int(lower.get("linebases", 60))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Parts:
        index, at = [], 0
        with self.part(".fa") as part:
            for b in iterator:
                for name, bases in zip(b.column("contig").to_pylist(), b.column("bases").to_pylist(), strict=True):
                    if name is None:
                        raise ValueError("a sequence has no contig name")
                    head, body = f">{name}\n".encode(), (bases or "").encode()
                    part.write(head)
                    at += len(head)
                    index.append(f"{name}\t{len(body)}\t{at}\t{self.line}\t{self.line + 1}\n")
                    for k in range(0, len(body), self.line):
                        part.write(body[k : k + self.line] + b"\n")
                    at += len(body) + -(-len(body) // self.line)
            part.beside(".fai", "".join(index).encode())
        return part.written


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return CONTIGS if self.options.get("header", "false").lower() == "true" else CHUNKS

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)


def write_indexed(sequences: DataFrame, path: str, line: int = 60) -> None:
    """Writes ``contig, bases`` as FASTA files with indexes."""
    register(sequences.sparkSession)
    sequences.select("contig", "bases").write.format("fasta").mode("append").option("lineBases", line).save(path)


def region_chunks(spark: SparkSession, path: str, regions: DataFrame, size: int = CHUNK, **options: str) -> DataFrame:
    """The chunks that ``regions`` (``contig, start, end``) touch, each once; nothing else is read. ``operators.sequence.cut_regions`` cuts the regions out of them."""
    register(spark)
    return spark.read.format("fasta").options(**options).option("chunkBases", size).option("regions", windows_of(regions, size)).load(path)
