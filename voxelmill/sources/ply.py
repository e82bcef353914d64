"""PLY files as a Spark data source: binary bodies are fixed-width records, so byte ranges are tasks.

Only little-endian binary and ASCII files with the vertex element first and scalar vertex properties are
read; everything else is refused with a message that says why."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError, UnsupportedSource
from .adapter import RAW
from .files import RANGE, open_file, ranges_table
from .layouts import NORMAL, PLY_FACE, PLY_VERTEX, VERTEX

# The format's scalar types.
SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
REQUIRED = RAW[:11]
#: Vertices that a file may have, unless the reader's option ``maxVertices`` says otherwise; bytes of a header.
MAX_VERTICES = 20_000_000
HEADER_LIMIT = 1 << 20
RECORDS_PER_TASK = 500_000
#: Vertices of one batch, and bytes of an ASCII body that are read at once.
BATCH, CHUNK = 50_000, 1 << 22


@dataclass(frozen=True)
class Header:
    binary: bool
    count: int
    names: tuple[str, ...]
    types: tuple[str, ...]
    offset: int

    @property
    def record(self) -> np.dtype:
        """Record layout; of properties with one name the last has it."""
        last = {n: i for i, n in enumerate(self.names)}
        return np.dtype([(n if last[n] == i else f"_{i}", "<" + t) for i, (n, t) in enumerate(zip(self.names, self.types, strict=True))])


def parse_header(head: bytes, most: int = MAX_VERTICES) -> Header:
    m = re.search(rb"end_header[ \t]*(\r\n|\n|\r)", head)
    if not head.startswith(b"ply") or not m:
        raise SourceError("not a PLY file: the header is missing or has no end_header")
    kind, count, names, types, element, first = "", 0, [], [], "", ""
    for line in head[: m.start()].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            element, first = w[1], first or w[1]
            count = int(w[2]) if element == "vertex" else count
        elif w[0] == "property" and element == "vertex":
            if w[1] == "list":
                raise UnsupportedSource("list properties in the vertex element are not supported")
            if w[1] not in SCALARS:
                raise UnsupportedSource(f"unknown property type {w[1]}")
            types.append(SCALARS[w[1]])
            names.append(w[2])
    if kind == "binary_big_endian":
        raise UnsupportedSource("big-endian PLY is not supported")
    if kind not in ("ascii", "binary_little_endian"):
        raise UnsupportedSource(f"unsupported PLY format {kind or '(none)'}")
    if count <= 0:
        raise SourceError("the PLY vertex element is empty")
    if count > most:
        raise SourceError(f"the PLY file has more than {most} vertices; the option maxVertices raises the limit")
    if first != "vertex":
        raise UnsupportedSource("elements before vertex are not supported")
    if missing := [n for n in REQUIRED if n not in names]:
        raise SourceError(f"missing PLY properties: {', '.join(missing)}")
    return Header(kind != "ascii", count, tuple(names), tuple(types), m.end())


@dataclass
class Range(InputPartition):
    first: int
    count: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, header: Header):
        self.path, self.header = path, header

    def partitions(self) -> list[Range]:
        step = RECORDS_PER_TASK if self.header.binary else self.header.count
        return [Range(a, min(step, self.header.count - a)) for a in range(0, self.header.count, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h, columns = self.header, [c for c in RAW if c in self.header.names]
        for start, rows in self._binary(part) if h.binary else self._ascii():
            arrays = [pa.array(np.arange(start, start + len(rows)), pa.int64())] + [pa.array(rows[c].astype(np.float64)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["gid", *columns])

    def _binary(self, part: Range) -> Iterator[tuple[int, np.ndarray]]:
        dtype = self.header.record
        with open_file(self.path) as f:
            f.seek(self.header.offset + part.first * dtype.itemsize)
            for a in range(0, part.count, BATCH):
                n = min(BATCH, part.count - a)
                data = f.read(n * dtype.itemsize)
                if len(data) < n * dtype.itemsize:
                    raise SourceError("the PLY vertex data is truncated")
                yield part.first + a, np.frombuffer(data, dtype)

    def _ascii(self) -> Iterator[tuple[int, np.ndarray]]:
        """The whole body in one task; ``read_ply`` reads it by ranges."""
        with open_file(self.path) as f:
            n = 0
            for rows in ascii_rows(self.header, range_lines(f, self.header.offset, f.size(), self.header.offset), self.header.count):
                yield n, rows
                n += len(rows)
        if n < self.header.count:
            raise SourceError("the PLY vertex data is truncated")


def range_lines(f, lo: int, hi: int, start: int) -> Iterator[bytes]:
    """The lines, but for blank ones, that begin in the bytes from ``lo`` to ``hi`` of a body that starts at ``start``."""
    at, rest, more = max(start, lo - 1), b"", True
    f.seek(at)
    skip = lo > start  # the line that has the byte before the range belongs to the range before
    while more:
        data = f.read(CHUNK)
        more = bool(data)
        *whole, rest = (rest + data.replace(b"\r", b"\n")).split(b"\n")
        for line in whole if more else [*whole, rest]:
            if at >= hi:
                return
            at += len(line) + 1
            if not skip and line.strip():
                yield line
            skip = False


def ascii_rows(header: Header, lines: Iterator[bytes], most: int) -> Iterator[np.ndarray]:
    """The values of the first ``most`` lines, in batches; of properties with one name the last counts."""
    last = {n: i for i, n in enumerate(header.names)}
    lines = islice(lines, most)
    while batch := [x.split() for x in islice(lines, BATCH)]:
        if any(len(x) < len(header.names) for x in batch):
            raise SourceError("the PLY vertex data is truncated")
        yield np.rec.fromarrays([np.array([float(x[i]) for x in batch]) for i in last.values()], names=list(last))


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: gid (row number) and the raw splat columns that the file has."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _header(self) -> Header:
        with open_file(self.options["path"]) as f:
            return parse_header(f.read(HEADER_LIMIT), int(self.options.get("maxVertices", MAX_VERTICES)))

    def schema(self) -> str:
        names = self._header().names
        return "gid bigint, " + ", ".join(f"{c} double" for c in RAW if c in names)

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options["path"], self._header())


def read_ply(spark: SparkSession, path: str, split: int = RANGE) -> DataFrame:
    """A PLY file: ranges of records are tasks, or ranges of ``split`` bytes of an ASCII body.  Its lines are counted first,
    range by range, so that each range knows the number of its first row."""
    spark.dataSource.register(PlySource)
    with open_file(path) as f:
        header, size = parse_header(f.read(HEADER_LIMIT)), f.size()
    if header.binary:
        return spark.read.format("ply").load(path)
    ranges = [(a, min(a + split, size)) for a in range(header.offset, size, split)]
    columns = [c for c in RAW if c in header.names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(path) as f:
            for b in batches:
                lo, hi = (c.to_pylist() for c in b.columns)
                n = [sum(1 for _ in range_lines(f, x, y, header.offset)) for x, y in zip(lo, hi)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["lo", "hi", "n"])

    counted = ranges_table(spark, ranges, "lo bigint, hi bigint").mapInArrow(count, "lo bigint, hi bigint, n bigint")
    known, first = [], 0
    for lo, hi, n in sorted(tuple(r) for r in counted.collect()):  # one row for each range
        if first < header.count:
            known.append((lo, hi, first, min(n, header.count - first)))
        first += n
    if first < header.count:
        raise SourceError("the PLY vertex data is truncated")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(path) as f:
            for b in batches:
                for lo, hi, gid, n in zip(*(c.to_pylist() for c in b.columns)):
                    for rows in ascii_rows(header, range_lines(f, lo, hi, header.offset), n):
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gid, gid + len(rows)), pa.int64()), *(pa.array(rows[c]) for c in columns)], ["gid", *columns])
                        gid += len(rows)

    return ranges_table(spark, known, "lo bigint, hi bigint, gid bigint, n bigint").mapInArrow(parse, "gid bigint, " + ", ".join(f"{c} double" for c in columns))


def read_mesh_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a mesh that ``write_ply`` has written, by ranges of records."""
    with open_file(path) as f:
        head = f.read(HEADER_LIMIT)
    end = head.index(b"end_header\n") + 11
    n, m = (int(re.search(rb"element %s (\d+)" % kind, head[:end])[1]) for kind in (b"vertex", b"face"))

    def table(dtype: np.dtype, at: int, rows: int, schema: str, columns) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open_file(path) as f:
                for b in batches:
                    for first, count in zip(*(c.to_pylist() for c in b.columns)):
                        f.seek(at + first * dtype.itemsize)
                        own = np.frombuffer(f.read(count * dtype.itemsize), dtype)
                        if len(own) < count:
                            raise SourceError("the PLY data is truncated")
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), *map(pa.array, columns(own))], [c.split()[0] for c in schema.split(", ")])

        parts = [(a, min(RECORDS_PER_TASK, rows - a)) for a in range(0, rows, RECORDS_PER_TASK)]
        return ranges_table(spark, parts, "first bigint, n bigint").mapInArrow(run, schema)

    floats = ", ".join(f"{c} float" for c in (*VERTEX, *NORMAL))
    vertices = table(PLY_VERTEX, end, n, f"vid bigint, {floats}, red tinyint, green tinyint, blue tinyint".replace("tinyint", "smallint"), lambda r: [*r["p"].T, *r["c"].T.astype(np.int16)])
    faces = table(PLY_FACE, end + n * PLY_VERTEX.itemsize, m, "fid bigint, a bigint, b bigint, c bigint", lambda r: list(r["i"].T.astype(np.int64)))
    return vertices, faces


def splat_ply_bytes(rows: list[dict[str, float]]) -> bytes:
    """A binary PLY of raw splat rows; missing columns are 0."""
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(rows)}\n" + "".join(f"property float {c}\n" for c in RAW) + "end_header\n"
    return head.encode() + np.array([[r.get(c, 0.0) for c in RAW] for r in rows], "<f4").tobytes()
