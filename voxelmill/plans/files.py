"""Queries that write files of the driver's tables and read them again, and conversions through the session."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gaussian import ACTIVATED
from ..operators import repair, surface
from ..params import Params
from ..session import SplatSession
from ..sources import packed, ply, sinks
from ..sources.adapter import RAW, raw_from_embeddings
from ..sources.files import open_file
from ..streaming import growing, slabs
from ..tables import adopted, new_path, remove, stored, write
from . import oracle as o
from . import registry as r
from .registry import query, rounded


def _through_file(spark: SparkSession, ending: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in the file that ``write`` has made; the file goes when the result is stored."""
    path = f"{new_path(spark, 'file')}.{ending}"
    try:
        write(path)
        return stored(read(path), "read-back")
    finally:
        remove(spark, path)


_SINGLES = o.sql(o.GAUSSIANS, select="SELECT gid, " + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) AS {c}" for c in RAW) + " FROM raw")


@query(_SINGLES)
def ply_source(spark, d):
    """Raw rows through a binary PLY file."""
    raw = raw_from_embeddings(spark, f"{d}/embeddings.parquet")
    return rounded(_through_file(spark, "ply", lambda p: sinks.write_splats(raw, p, "splat-ply"), lambda p: ply.read_ply(spark, p)))


@query(_SINGLES)
def ply_ascii_source(spark, d):
    """Raw rows through an ASCII PLY file, read by ranges of bytes."""
    raw = raw_from_embeddings(spark, f"{d}/embeddings.parquet")
    return rounded(_through_file(spark, "ply", lambda p: sinks.write_splats(raw, p, "splat-ply-ascii"), lambda p: ply.read_ply(spark, p, 1 << 16)))


_BYTES = ", ".join(f"(least(255, greatest(0, floor(u.{c} * 128 + 128.5))) - 128) / 128 AS {c}" for c in "wabc")
_TURNED = """w * w + a * a - b * b - c * c AS r0, 2 * a * b - 2 * w * c AS r1, 2 * a * c + 2 * w * b AS r2, 2 * a * b + 2 * w * c AS r3, w * w - a * a + b * b - c * c AS r4, 2 * b * c - 2 * w * a AS r5,
  2 * a * c - 2 * w * b AS r6, 2 * b * c + 2 * w * a AS r7, w * w - a * a - b * b + c * c AS r8"""


@query(o.sql(o.GAUSSIANS, f"packed AS (SELECT g.*, {_BYTES} FROM act g JOIN unit u USING (gid)), sized_ AS (SELECT *, sqrt(w * w + a * a + b * b + c * c) AS size FROM packed), even AS (SELECT gid, x, y, z, s0, s1, s2, opacity, cr, cg, cb, w / size AS w, a / size AS a, b / size AS b, c / size AS c FROM sized_)",
             select=f"SELECT gid, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) AS {c}' for c in ('x', 'y', 'z'))}, {', '.join(f'round(CAST(CAST(greatest(0.000001, {c}) AS FLOAT) AS DOUBLE), 5) AS {c}' for c in ('s0', 's1', 's2'))}, {', '.join(f'round(floor({c} * 255 + 0.5) / 255, 5) AS {c}' for c in ('opacity', 'cr', 'cg', 'cb'))}, {', '.join(f'round(r{k}, 5) AS r{k}' for k in range(9))} FROM (SELECT *, {_TURNED} FROM even)"))
def splat_source(spark, d):
    """Activated rows through a file of SPLAT records, read by ranges of records."""
    s = r.scene(spark, d)
    length = F.sqrt(sum((F.col(f"rot_{k}") ** 2 for k in range(4)), F.lit(0.0)))
    turn = s.raw.select("gid", *[F.when(length < 1e-5, float(k == 0)).otherwise(F.col(f"rot_{k}") / length).alias(f"q{k}") for k in range(4)])
    rows = s.every.join(turn, "gid")
    out = _through_file(spark, "splat", lambda p: sinks.write_splats(rows, p, "splat"), lambda p: packed.read_splat(spark, p, 100))
    return rounded(out.select("gid", *ACTIVATED), digits=5)


@query(o.sql(*r._COARSE, select="SELECT fid, a, b, c FROM faces"))
def ply_sink(spark, d):
    """The surface's faces, out of the PLY file that it was written to."""
    m = r.surface_of(spark, d)[0]
    return _through_file(spark, "ply", lambda p: sinks.write_ply(m, p), lambda p: ply.read_mesh_ply(spark, p)[1])


@query(o.sql(*r._COARSE, select="SELECT vid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM vertices"))
def ply_sink_vertices(spark, d):
    m = r.surface_of(spark, d)[0]
    out = _through_file(spark, "ply", lambda p: sinks.write_ply(m, p), lambda p: ply.read_mesh_ply(spark, p)[0])
    return rounded(out.select("vid", "x", "y", "z"), digits=4)


@query(o.sql(*r._COARSE, select="SELECT a + 1 AS a, b + 1 AS b, c + 1 AS c, count(*) AS n FROM faces GROUP BY ALL UNION ALL SELECT -1, -1, -1, count(*) FROM vertices"))
def obj_sink(spark, d):
    """Faces in the OBJ file, which count from 1, and a row with the number of its vertices."""
    m = r.surface_of(spark, d)[0]

    def read(path: str) -> DataFrame:
        rows = spark.read.text(path).select(F.split("value", "[ /]+").alias("w"))
        faces = rows.where("w[0] = 'f'").selectExpr("CAST(w[1] AS BIGINT) AS a", "CAST(w[3] AS BIGINT) AS b", "CAST(w[5] AS BIGINT) AS c").groupBy("a", "b", "c").agg(F.count("*").alias("n"))
        return faces.unionByName(rows.where("w[0] = 'v'").agg(*[F.lit(-1).cast("bigint").alias(c) for c in "abc"], F.count("*").alias("n")))

    return _through_file(spark, "obj", lambda p: sinks.write_obj(m, p), read)


@query(o.sql(*r._COARSE, select="SELECT (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM faces) * 3 AS indices, " + ", ".join(f"(SELECT round({f}({c}), 4) FROM vertices) AS {f}_{c}" for f in ("min", "max") for c in "xyz")))
def glb_sink(spark, d):
    """What the GLB file says of its parts."""
    m = r.surface_of(spark, d)[0]

    def read(path: str) -> DataFrame:
        with open_file(path) as f:
            head = f.read(20)
            parts = json.loads(f.read(struct.unpack("<I", head[12:16])[0]))["accessors"]
        row = (parts[0]["count"], parts[3]["count"], *(round(v, 4) for v in (*parts[0]["min"], *parts[0]["max"])))
        return spark.createDataFrame([row], "vertices bigint, indices bigint, " + ", ".join(f"{f}_{c} double" for f in ("min", "max") for c in "xyz"))

    return _through_file(spark, "glb", lambda p: sinks.write_glb(m, p), read)


@query(o.sql(*r._FINE, o.STATS, r._OCC, r._DENOISED, "kept_ AS (SELECT i, j, k FROM both_, grid WHERE CASE WHEN i BETWEEN 1 AND nx - 2 AND j BETWEEN 1 AND ny - 2 AND k BETWEEN 1 AND nz - 2 THEN CASE WHEN own THEN near > 1 ELSE near >= 5 END ELSE own END)",
             select="SELECT (coalesce(v.k, o.k) * ny + coalesce(v.j, o.j)) * nx + coalesce(v.i, o.i) AS vid, round(CAST(CAST(CASE WHEN o.i IS NOT NULL AND coalesce(density::DOUBLE, 0) < iso THEN iso + greatest(0.000001, abs(iso) * 0.0001) WHEN o.i IS NULL AND density::DOUBLE >= iso THEN greatest(0, iso - greatest(0.000001, abs(iso) * 0.0001)) ELSE density::DOUBLE END AS FLOAT) AS DOUBLE), 5) AS density FROM vox v FULL JOIN kept_ o ON v.i = o.i AND v.j = o.j AND v.k = o.k CROSS JOIN grid CROSS JOIN auto"))
def reclassified(spark, d):
    """The field after one round of denoising: points that changed sides lie just beyond the threshold."""
    _, grid, voxels = r.field(spark, d, r.FINE)
    return rounded(repair.process_field(voxels, grid, r.iso_of(voxels, grid), denoise_iterations=1).voxels.select("vid", "density"), digits=5)


_EDGEWISE = ", twins AS MATERIALIZED (SELECT DISTINCT p.fid AS a, q.fid AS b FROM sides p JOIN sides q ON least(p.u, p.v) = least(q.u, q.v) AND greatest(p.u, p.v) = greatest(q.u, q.v) AND p.fid <> q.fid), reach_e(fid, low) AS (SELECT fid, fid FROM kept UNION SELECT t.b, e.low FROM reach_e e JOIN twins t ON t.a = e.fid WHERE t.b > e.low), comp_e AS (SELECT fid, min(low) AS low FROM reach_e GROUP BY 1), mult AS (SELECT count(*) AS m FROM sides SEMI JOIN kept USING (fid) GROUP BY least(u, v), greatest(u, v))"
_CROSS = [f"((q.{a} - p.{a}) * (s.{b} - p.{b}) - (q.{b} - p.{b}) * (s.{a} - p.{a}))" for a, b in ("yz", "zx", "xy")]


@query(o.sql(*r._COARSE, r._pass("vertices", "p1"), r._pass("p1", "p2"), recursive=r._KEPT + _EDGEWISE,
             select=f"SELECT round((SELECT iso FROM auto), 5) AS iso, (SELECT count(*) FROM ids) AS vertices, (SELECT count(*) FROM kept) AS faces, (SELECT count(*) FROM mult WHERE m = 1) AS boundary_edges, (SELECT count(*) FROM mult WHERE m > 2) AS non_manifold_edges, (SELECT count(*) FROM kept JOIN p2 p ON p.vid = a JOIN p2 q ON q.vid = b JOIN p2 s ON s.vid = c WHERE {' + '.join(f'{x} * {x}' for x in _CROSS)} <= 2.220446049250313e-16) AS degenerate_faces, (SELECT count(DISTINCT low) FROM comp_e) AS components"))
def session_conversion(spark, d):
    """A conversion from raw rows through the session: components of at least 24 faces, smoothed once."""
    s = SplatSession(spark)
    try:
        s.load_raw(raw_from_embeddings(spark, f"{d}/embeddings.parquet"), "parquet")
        out = s.start(Params(resolution=r.COARSE, keep_largest=False, min_component_faces=24, smoothing=1))
        told = out.metadata()
        row = (round(out.iso, 5), told["vertices"], told["triangles"], *out.quality.first())
    finally:
        s.dispose()
    return spark.createDataFrame([row], "iso double, vertices bigint, faces bigint, boundary_edges bigint, non_manifold_edges bigint, degenerate_faces bigint, components bigint")


def _slabs(spark: SparkSession, d: str, resolution: int) -> tuple[slabs.Slabs, float]:
    """The field by slabs of eight layers, and its threshold."""
    s = r.scene(spark, d)
    field = slabs.density_by_slabs(s.gaussians, r.grid_of(s, resolution), r.SIGMA, 8)
    return field, r.iso_of(field.whole(), field.grid)


@query(r.ORACLE_SQL["reclassified"])
def slab_reclassified(spark, d):
    """The denoised field, slab by slab."""
    field, iso = _slabs(spark, d, r.FINE)
    return rounded(slabs.repair_by_slabs(field, iso, 8, denoise_iterations=1)[0].whole().select("vid", "density"), digits=5)


@query(r.ORACLE_SQL["enclosed_voids"])
def slab_voids(spark, d):
    """Voids of the shell, whose parts in slabs are merged over the faces between them."""
    field, iso = _slabs(spark, d, r.FINE)
    shell = slabs.Slabs(spark, field.grid, 8, slabs.POINTS).fill(lambda a, b: field.layers(a, b).where(F.col("density").cast("double").between(iso, iso * 4)))
    return slabs.voids_by_slabs(shell, 8).select(*[F.col(c).cast("int") for c in "ijk"])


@query(r.ORACLE_SQL["signed_distance"])
def slab_distance(spark, d):
    """Signed distances, each slab with the layers around it that the band reaches."""
    field, iso = _slabs(spark, d, r.COARSE)
    return rounded(slabs.repair_by_slabs(field, iso, 8, band=4)[0].whole(), digits=4)


@query(r.ORACLE_SQL["mesh_faces"])
def slab_faces(spark, d):
    """The surface from crossings that were found slab by slab."""
    field, iso = _slabs(spark, d, r.COARSE)
    return surface.extract_mesh(field.whole(), None, field.grid, iso, r.SIGMA, rows=slabs.slab_crossings(field, iso)).faces


_GROWN = """peak AS (SELECT CAST(floor(log2(max(CAST(density AS DOUBLE)) / 64)) + 1 AS INTEGER) AS exponent FROM vox),
grown AS (SELECT CAST(floor(CAST(density AS DOUBLE) / pow(2, exponent)) AS INTEGER) AS bin, exponent, count(*) AS n FROM vox, peak WHERE density > 0 GROUP BY 1, 2),
summed AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM grown)"""


@query(o.sql(o.GAUSSIANS, o.BOUNDS, o.grid(r.FIELD), o.VOXELS, _GROWN, select="SELECT bin, exponent, n, (SELECT min(bin) + 0.5 FROM summed WHERE upto >= greatest(1, ceil(total * 0.55))) * pow(2, exponent) AS iso FROM grown"))
def stream_histogram(spark, d):
    """Embeddings as a stream of Gaussians in several triggers: the histogram and the threshold that follow it."""
    s = r.scene(spark, d)
    grid = r.grid_of(s, r.FIELD)
    source, path = new_path(spark, "stream-source"), new_path(spark, "stream-histograms")
    parts = adopted(write(s.gaussians.repartition(4, "gid"), source), source)
    with_history = growing.run_files(spark, source, parts.schema, grid, r.SIGMA, path, new_path(spark, "stream-state"))
    adopted(with_history, path)
    return with_history.select("*")
