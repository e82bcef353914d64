"""Packed splat files as activated rows: SPLAT (32-byte records) and SPZ (versions 2 and 3)."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SourceError, UnsupportedSource
from ..functions.gaussian import ACTIVATED, C0
from ..operators.activate import finite
from .files import list_files, open_file, ranges_table
from .layouts import SPLAT

#: Records of a SPLAT file that are a task, and records or points of a batch.
RECORDS, BATCH = 1_000_000, 50_000
#: Bits of a point's number in its file, where files have no known number of points.
POINT_BITS = 32
SPZ_MAGIC = 0x5053474E
SCHEMA = "gid bigint, " + ", ".join(f"{c} double" for c in ACTIVATED)


def matrices(q: np.ndarray) -> np.ndarray:
    """Row-major matrices of quaternions (w, x, y, z), of any length; identity for those near zero."""
    n = np.linalg.norm(q, axis=1, keepdims=True)
    w, x, y, z = np.where(n < 1e-5, [1.0, 0, 0, 0], q / np.maximum(n, 1e-30)).T
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, axis=1)


def activated_batch(first: int, p: np.ndarray, s: np.ndarray, q: np.ndarray, opacity: np.ndarray, color: np.ndarray) -> pa.RecordBatch:
    table = np.hstack([p, np.maximum(1e-6, s), matrices(q), opacity[:, None], color]).astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(p)), pa.int64()), *(pa.array(c) for c in table.T)], ["gid", *ACTIVATED])


def splat_rows(data: bytes) -> tuple[np.ndarray, ...]:
    if not data or len(data) % SPLAT.itemsize:
        raise SourceError("could not decode SPLAT: the size is not a multiple of 32 bytes")
    r = np.frombuffer(data, SPLAT)
    return r["p"], r["s"], (r["q"].astype(np.float64) - 128) / 128, r["c"][:, 3] / 255.0, r["c"][:, :3] / 255.0


def smallest_three(raw: np.ndarray) -> np.ndarray:
    """Quaternions (w, x, y, z) of 32 bits: two name the largest part, three times ten hold the others."""
    bits = raw.astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32)
    largest, out = bits >> 30, np.zeros((len(raw), 4))
    for part in (3, 2, 1, 0):
        other = largest != part
        value = (bits & 511) / 511 * np.sqrt(0.5) * np.where(bits >> 9 & 1, -1.0, 1.0)
        out[other, part] = value[other]
        bits = np.where(other, bits >> 10, bits)
    at = np.arange(len(raw))
    out[at, largest] = np.sqrt(np.maximum(0, 1 - (out**2).sum(axis=1)))
    return out[:, [3, 0, 1, 2]]


def spz_rows(data: bytes) -> tuple[np.ndarray, ...]:
    if data[:2] != b"\x1f\x8b":
        raise UnsupportedSource("could not decode SPZ: not gzip data, as of a newer version")
    data = gzip.decompress(data)
    magic, version, n = (int(x) for x in np.frombuffer(data[:12], "<u4"))
    if magic != SPZ_MAGIC or version not in (2, 3):
        raise UnsupportedSource(f"could not decode SPZ: version {version} is not supported")
    fraction, at = data[13], 16
    width = {"p": 9, "a": 1, "c": 3, "s": 3, "q": 3 if version == 2 else 4}
    if len(data) < at + n * sum(width.values()):
        raise SourceError("could not decode SPZ: the data is truncated")
    part = {}
    for k, w in width.items():
        part[k] = np.frombuffer(data, np.uint8, n * w, at).reshape(n, w)
        at += n * w
    fixed = part["p"].reshape(n, 3, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32)
    p = (fixed - ((fixed >> 23 & 1) << 24)) / float(1 << fraction)
    if version == 2:
        v = part["q"] / 127.5 - 1
        q = np.hstack([np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))[:, None], v])
    else:
        q = smallest_three(part["q"])
    color = np.clip(0.5 + float(C0) * (part["c"] / 255.0 - 0.5) / 0.15, 0, 1)
    return p, np.exp(part["s"] / 16.0 - 10), q, part["a"][:, 0] / 255.0, color


def read_splat(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """A SPLAT file or a folder of them: ranges of records are tasks.  gid counts on from file to file, in order of names."""
    ranges, first = [], 0
    for name, size in list_files(path, (".splat",)):
        if not size or size % SPLAT.itemsize:
            raise SourceError("could not decode SPLAT: the size is not a multiple of 32 bytes")
        n = size // SPLAT.itemsize
        ranges += [(name, a, min(records, n - a), first + a) for a in range(0, n, records)]
        first += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at, n, gid in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(name) as f:
                    f.seek(at * SPLAT.itemsize)
                    for a in range(0, n, BATCH):
                        yield activated_batch(gid + a, *splat_rows(f.read(min(BATCH, n - a) * SPLAT.itemsize)))

    return ranges_table(spark, ranges, "name string, at bigint, n bigint, gid bigint").mapInArrow(run, SCHEMA).where(finite(*ACTIVATED))


def read_spz(spark: SparkSession, path: str) -> DataFrame:
    """SPZ in any store that Spark reads; a file is one task, as its format is one compressed block.  gid is the point's
    number in its file, with the file's number (in order of names, from 0) above it."""
    files = spark.read.format("binaryFile").load(path)
    numbers = files.select("path").withColumn("file", F.row_number().over(Window.orderBy("path")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, file in zip(b.column("content"), b.column("file").to_pylist()):
                parts = spz_rows(content.as_py())
                for a in range(0, len(parts[0]), BATCH):
                    yield activated_batch((file << POINT_BITS) + a, *(x[a : a + BATCH] for x in parts))

    return files.join(numbers, "path").select("content", "file").mapInArrow(run, SCHEMA).where(finite(*ACTIVATED))


def from_activated(df: DataFrame, threshold: float) -> DataFrame:
    """Rows of the activated schema: numbers only, opacity at least the threshold; opacity and color are clamped."""
    clamp = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))).alias(c) for c in ("opacity", "cr", "cg", "cb")]
    own = df.where(finite(*ACTIVATED)).select("gid", *ACTIVATED[:15], *clamp)
    return own.where(F.col("opacity") >= threshold)
