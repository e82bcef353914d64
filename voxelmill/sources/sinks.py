"""Meshes and splats to files, reports to JSON.  Files are encoded by tasks and joined when all are done."""

from __future__ import annotations

import json
import struct
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..operators.surface import Mesh
from .adapter import RAW
from .files import write_file
from .layouts import COLOR, NORMAL, VERTEX

REPORT_SCHEMA = "voxelmill/benchmark-v1"
NAMES = VERTEX + NORMAL + COLOR


def _sections(mesh: Mesh, *parts: tuple[str, ...]) -> DataFrame:
    """The vertices once for each of ``parts`` (columns), then the faces, as rows of sections in this order."""
    out = None
    every = sorted({c for p in parts for c in p}, key=NAMES.index)
    none = lambda have, kind: [F.lit(None).cast(kind).alias(c) for c in have]
    for k, part in enumerate(parts):
        rows = mesh.vertices.select(F.lit(k).alias("section"), F.col("vid").alias("id"), *[F.col(c) if c in part else F.lit(None).cast("double").alias(c) for c in every], *none("abc", "bigint"))
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(mesh.faces.select(F.lit(len(parts)).alias("section"), F.col("fid").alias("id"), *none(every, "double"), *[F.col(c).cast("bigint").alias(c) for c in "abc"]))


def write_ply(mesh: Mesh, path: str) -> None:
    """Binary little-endian: float positions and normals, byte colors, triangles; non-finite numbers become 0."""
    props = "".join(f"property float {c}\n" for c in (*VERTEX, *NORMAL)) + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {mesh.vertices.count()}\n{props}element face {mesh.faces.count()}\nproperty list uchar int vertex_indices\nend_header\n"
    write_file(_sections(mesh, VERTEX + NORMAL + COLOR), path, "ply", head.encode())


def write_obj(mesh: Mesh, path: str) -> None:
    """Text with colors after positions, normals, and faces that count from 1."""
    write_file(_sections(mesh, VERTEX + COLOR, NORMAL), path, "obj", b"# vertex colors follow the position\n")


def write_glb(mesh: Mesh, path: str) -> None:
    """glTF 2.0 binary: one indexed primitive with normals, colors and a double-sided material.  Sizes follow from the
    counts, so each part is streamed in its turn."""
    n, m = mesh.vertices.count(), mesh.faces.count()
    views, at = [], 0
    for size, target in ((12 * n, 34962), (12 * n, 34962), (12 * n, 34962), (12 * m, 34963)):
        views.append({"buffer": 0, "byteOffset": at, "byteLength": size, "target": target})
        at += size
    box = mesh.vertices.agg(*[f(F.col(c).cast("float").cast("double")) for f in (F.min, F.max) for c in "xyz"]).first()
    ends = {"min": list(box[:3]), "max": list(box[3:])} if n else {}
    accessors = [{"bufferView": k, "componentType": 5126, "count": n, "type": "VEC3"} | (ends if k == 0 else {}) for k in range(3)]
    accessors.append({"bufferView": 3, "componentType": 5125, "count": 3 * m, "type": "SCALAR"})
    doc = {
        "asset": {"version": "2.0", "generator": "voxelmill"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "NORMAL": 1, "COLOR_0": 2}, "indices": 3, "material": 0}]}],
        "materials": [{"doubleSided": True, "pbrMetallicRoughness": {"metallicFactor": 0.0, "roughnessFactor": 0.8}}],
        "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": at}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    head = struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(text) + 8 + at) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", at, b"BIN\0")
    write_file(_sections(mesh, VERTEX, NORMAL, COLOR), path, "glb", head)


def write_splats(rows: DataFrame, path: str, layout: str) -> None:
    """Splat rows in order of gid: ``splat`` (activated rows, with the quaternion q0 to q3), ``splat-ply`` or
    ``splat-ply-ascii`` (raw rows, floats)."""
    head = b""
    if layout != "splat":
        kind = "ascii" if layout.endswith("ascii") else "binary_little_endian"
        head = f"ply\nformat {kind} 1.0\nelement vertex {rows.count()}\n{''.join(f'property float {c}{chr(10)}' for c in RAW)}end_header\n".encode()
    write_file(rows.withColumn("section", F.lit(0)).withColumn("id", F.col("gid")), path, layout, head)


def output_name(source: str, extension: str) -> str:
    """Name of the output beside a source: its stem without a known extension, and -mesh."""
    from . import FORMATS

    base = source.replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return f"{(stem if dot and ext.lower() in FORMATS else base) or 'scene'}-mesh.{extension}"


def benchmark_report(result, source: str, source_bytes: int, elapsed_ms: dict[str, float], params: dict) -> str:
    """A JSON report of a conversion."""
    s = result.stats.first()
    return json.dumps({
        "schema": REPORT_SCHEMA, "timestamp": datetime.now(timezone.utc).isoformat(), "environment": {"engine": "spark"}, "gpu": None,
        "source": {"name": source, "bytes": source_bytes, "format": result.report["source_format"], "inputGaussians": result.report["input_count"], "retainedGaussians": result.report["retained_count"]},
        "params": params,
        "result": {"backend": "spark", "dims": list(result.grid.dims), "voxelCount": result.grid.voxels, "densityRange": [s["min_density"], s["max_density"]], "vertices": result.mesh.vertices.count(), "triangles": result.mesh.faces.count(), "elapsedMs": elapsed_ms, "backendTimingsMs": None, "validation": None, "topology": result.quality.first().asDict()},
    })


def summarize_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report file below ``path``, by name; a report of another schema is an error, no file gives no row."""
    schema = "schema string, gpu struct<vendor:string,device:string>, result struct<backend:string,dims:array<int>,backendTimingsMs:struct<compute:double>,validation:struct<maxAbsError:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    other = rows.where(~F.col("schema").eqNullSafe(REPORT_SCHEMA)).select("file").first()
    if other:
        raise SourceError(f"{other[0]}: unsupported benchmark schema")
    return rows.select(
        F.coalesce("gpu.vendor", F.lit("Unknown")).alias("vendor"), F.coalesce("gpu.device", F.lit("Unreported")).alias("device"), F.col("result.backend").alias("backend"),
        F.array_join(F.col("result.dims").cast("array<string>"), "×").alias("grid"), F.round(F.coalesce("result.backendTimingsMs.compute", F.lit(0.0))).alias("compute_ms"),
        F.coalesce("result.validation.maxAbsError", F.lit(0.0)).alias("max_abs_error"), "file",
    ).orderBy("file")
