"""Queries of the splat engine over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gaussian as g
from ..operators import activate, bounds, decimate, density, diagnostics, holes, mesh, repair, stats, surface
from ..operators.bounds import Grid
from ..sources.adapter import raw_from_embeddings
from ..tables import scoped, stored
from . import oracle as o

SIGMA, THRESHOLD, Q = o.SIGMA, o.THRESHOLD, o.Q
FIELD, FINE, COARSE = 32, 20, 14  # resolutions; SQL of surfaces is slow on finer grids
PRESET = 64  # where no SQL is held against


@dataclass(frozen=True)
class Scene:
    raw: DataFrame
    every: DataFrame
    gaussians: DataFrame


def scene(spark: SparkSession, sf_dir: str) -> Scene:
    """Activated Gaussians as a table: what follows doesn't compute their exponentials again."""
    raw = raw_from_embeddings(spark, f"{sf_dir}/embeddings.parquet")
    every = stored(activate.activate(raw), "gaussians")
    return Scene(raw, every, activate.select_gaussians(every, THRESHOLD))


def grid_of(s: Scene, resolution: int) -> Grid:
    return bounds.make_grid(*bounds.robust_bounds(s.gaussians, SIGMA, Q), resolution)


def field(spark: SparkSession, sf_dir: str, resolution: int) -> tuple[Scene, Grid, DataFrame]:
    s = scene(spark, sf_dir)
    grid = grid_of(s, resolution)
    return s, grid, stored(density.density_fanout(s.gaussians, grid, SIGMA), "voxels")


def iso_of(voxels: DataFrame, grid: Grid) -> float:
    st = stats.density_stats(voxels, grid)
    return float(stats.automatic_iso(st, stats.density_histogram(voxels, st)).first()[0])


def surface_of(spark: SparkSession, sf_dir: str, resolution: int = COARSE, colored: bool = False) -> tuple[surface.Mesh, Grid]:
    s, grid, voxels = field(spark, sf_dir, resolution)
    return surface.extract_mesh(voxels, s.gaussians if colored else None, grid, iso_of(voxels, grid), SIGMA), grid


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits: results show six decimals."""
    return df.select(*keys, *[F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys])


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, order: tuple[str, ...] = ()):
    def add(f):
        f = QUERIES[f.__name__] = scoped(f, order)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(o.sql(o.GAUSSIANS, select=f"SELECT gid, {_r(*g.ACTIVATED)} FROM act"))
def activated(spark, d):
    return rounded(scene(spark, d).every)


@query(o.sql(o.GAUSSIANS, select=f"SELECT gid, {_r(*[f'r{i}' for i in range(9)])} FROM act"))
def quat_matrix(spark, d):
    return rounded(scene(spark, d).every.select("gid", *[f"r{i}" for i in range(9)]))


@query(o.sql(o.GAUSSIANS, select="SELECT gid, " + ", ".join(f"round({h}, 6) AS h{c}" for h, c in zip(o.H, "xyz")) + " FROM ga"))
def support_extent(spark, d):
    return rounded(scene(spark, d).gaussians.select("gid", *[F.expr(g.half_extent(a, SIGMA)).alias(f"h{c}") for a, c in enumerate("xyz")]))


_CROP = "x BETWEEN ax + (bx - ax) * 0.3 AND ax + (bx - ax) * 0.7 AND y BETWEEN ay + (by_ - ay) * 0.3 AND ay + (by_ - ay) * 0.7 AND z BETWEEN az + (bz - az) * 0.3 AND az + (bz - az) * 0.7"
_CENTERS = "ends AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM act)"


@query(o.sql(o.GAUSSIANS, _CENTERS, select=f"SELECT count(*) AS input_count, CAST(0 AS BIGINT) AS rejected_non_finite, count(*) FILTER (opacity < {0.9}) AS rejected_opacity, count(*) FILTER (opacity >= {0.9} AND NOT ({_CROP})) AS rejected_crop, count(*) FILTER (opacity >= {0.9} AND {_CROP}) AS retained_count FROM act, ends"))
def filter_report(spark, d):
    s = scene(spark, d)
    return activate.load_report(s.raw, s.every, 0.9, activate.crop_box(s.every, (0.3,) * 3, (0.7,) * 3))


@query(o.sql(o.GAUSSIANS, _CENTERS, select=f"SELECT gid, {_r('x', 'y', 'z', 'opacity')} FROM act, ends WHERE opacity >= {THRESHOLD} AND {_CROP}"))
def crop_filter(spark, d):
    s = scene(spark, d)
    return rounded(activate.select_gaussians(s.every, THRESHOLD, activate.crop_box(s.every, (0.3,) * 3, (0.7,) * 3)).select("gid", "x", "y", "z", "opacity"))


@query("SELECT count(*) AS n, count(*) FILTER (" + " AND ".join(f"isfinite(CAST(embedding[{k}] AS DOUBLE))" for k in range(1, 12)) + ") AS finite FROM embeddings")
def finite_report(spark, d):
    raw = scene(spark, d).raw
    return raw.agg(F.count("*").alias("n"), F.count_if(activate.finite(*activate.REQUIRED)).alias("finite"))


@query(o.sql(o.GAUSSIANS, "r AS (SELECT *, row_number() OVER (ORDER BY gid) - 1 AS row, count(*) OVER () AS n FROM act)", select=f"SELECT gid, {_r('x', 'y', 'z')} FROM r WHERE row IN (SELECT (i * (SELECT max(n) FROM r)) // 120 FROM range(120) t(i))"))
def preview_sample(spark, d):
    return rounded(activate.preview(scene(spark, d).every, 120).select("gid", "x", "y", "z"))


@query(o.sql(o.GAUSSIANS, "v AS (SELECT greatest(s0, s1, s2) / least(s0, s1, s2) AS v FROM ga), l AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM v)", select=f"SELECT round(l[{o._rank(0.95)}], 6) AS p95, round(l[{o._rank(0.99)}], 6) AS p99, round(l[n], 6) AS largest FROM l"))
def scale_ratio_quantiles(spark, d):
    v = scene(spark, d).gaussians.select((F.greatest("s0", "s1", "s2") / F.least("s0", "s1", "s2")).alias("v"))
    return rounded(spark.createDataFrame([tuple(bounds.quantiles(v, "v", [0.95, 0.99, 1.0]))], "p95 double, p99 double, largest double"))


@query(o.sql(o.GAUSSIANS, "rated AS (SELECT *, greatest(s0, s1, s2) / least(s0, s1, s2) AS v FROM ga), l AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM rated)", select=f"SELECT gid, {_r('x', 'y', 'z')} FROM rated, l WHERE v >= l[{o._rank(0.95)}]"))
def diagnostic_anisotropic(spark, d):
    return rounded(activate.diagnostic_subset(scene(spark, d).gaussians, "anisotropic").select("gid", "x", "y", "z"), "gid")


@query(o.sql(o.GAUSSIANS, "l AS (SELECT list_sort(list(x)) AS lx, list_sort(list(y)) AS ly, list_sort(list(z)) AS lz, count(*) AS n FROM ga)", select=f"SELECT gid, {_r('x', 'y', 'z')} FROM ga, l WHERE " + " AND ".join(f"{c} BETWEEN l{c}[{o._rank(0.3)}] AND l{c}[{o._rank(0.7)}]" for c in "xyz")))
def diagnostic_crop(spark, d):
    return rounded(activate.diagnostic_subset(scene(spark, d).gaussians, "crop").select("gid", "x", "y", "z"), "gid")


@query(o.sql(o.GAUSSIANS, o.BOUNDS, select=f"SELECT {_r('lox', 'loy', 'loz', 'hix', 'hiy', 'hiz')} FROM bounds"))
def robust_bounds(spark, d):
    low, high = bounds.robust_bounds(scene(spark, d).gaussians, SIGMA, Q)
    return rounded(spark.createDataFrame([(*low, *high)], "lox double, loy double, loz double, hix double, hiy double, hiz double"))


@query(o.sql(o.GAUSSIANS, o.BOUNDS, o.grid(FIELD), select="SELECT round(sp, 6) AS spacing, nx, ny, nz, nx * ny * nz AS voxels, 4 * nx * ny * nz AS bytes FROM grid"))
def grid_dims(spark, d):
    grid = grid_of(scene(spark, d), FIELD)
    return rounded(spark.createDataFrame([(grid.spacing, *grid.dims, grid.voxels, grid.bytes)], "spacing double, nx bigint, ny bigint, nz bigint, voxels bigint, bytes bigint"))


def _tile(c: str, a: int, sign: str, up: str) -> str:
    return f"CAST(greatest(0, least(ceil(n{c} / 8.0) - 1, floor((({c} {sign} ({o.H[a]})) - lo{c}) / sp / 8 + {up}))) AS BIGINT)"



def _tiles_sql() -> str:
    step, source = [], "ga, grid"
    for a, c in enumerate("xyz"):
        step.append(f"t{a} AS (SELECT *, unnest(range({_tile(c, a, '-', '0')}, {_tile(c, a, '+', '0.999999 / 8')} + 1)) AS t{c} FROM {source})")
        source = f"t{a}"
    return ", ".join(step)


@query(o.sql(o.GAUSSIANS, o.BOUNDS, o.grid(FIELD), _tiles_sql(), select="SELECT CAST((tz * ceil(ny / 8.0) + ty) * ceil(nx / 8.0) + tx AS BIGINT) AS tile_id, count(*) AS candidates, CAST(sum(gid) AS BIGINT) AS gids FROM t2 GROUP BY 1"))
def tile_candidates(spark, d):
    s = scene(spark, d)
    return density.tile_candidates(s.gaussians, grid_of(s, FIELD), SIGMA).groupBy("tile_id").agg(F.count("*").alias("candidates"), F.sum("gid").alias("gids"))


_FIELD = (o.GAUSSIANS, o.BOUNDS, o.grid(FIELD), o.VOXELS)
_FINE = (o.GAUSSIANS, o.BOUNDS, o.grid(FINE), o.VOXELS)
_COARSE = (o.GAUSSIANS, o.BOUNDS, o.grid(COARSE), o.VOXELS, o.STATS, o.SURFACE, o.MESH)


@query(o.sql(*_FIELD, select="SELECT vid, i, j, k, round(CAST(density AS DOUBLE), 5) AS density FROM vox"))
def density_fanout(spark, d):
    return rounded(field(spark, d, FIELD)[2], digits=5)


@query(o.sql(*_FIELD, select="SELECT vid, i, j, k, round(CAST(density AS DOUBLE), 5) AS density FROM vox"))
def density_tilejoin(spark, d):
    s = scene(spark, d)
    return rounded(density.density_tilejoin(s.gaussians, grid_of(s, FIELD), SIGMA), digits=5)


@query(o.sql(*_FIELD, o.STATS, select="SELECT round(min_density, 5) AS min_density, round(max_density, 5) AS max_density, non_zero FROM stats"))
def density_stats(spark, d):
    _, grid, voxels = field(spark, d, FIELD)
    return rounded(stats.density_stats(voxels, grid), digits=5)


@query(o.sql(*_FIELD, o.STATS, select="SELECT bin, n FROM histogram"))
def density_histogram(spark, d):
    _, grid, voxels = field(spark, d, FIELD)
    return stats.density_histogram(voxels, stats.density_stats(voxels, grid))


@query(o.sql(*_FIELD, o.STATS, select="SELECT round(iso, 5) AS iso FROM auto"))
def auto_iso(spark, d):
    _, grid, voxels = field(spark, d, FIELD)
    st = stats.density_stats(voxels, grid)
    return rounded(stats.automatic_iso(st, stats.density_histogram(voxels, st)), digits=5)


@query(o.sql(*_FIELD, o.STATS, select="SELECT k, count(*) AS occupied FROM vox, auto WHERE CAST(density AS DOUBLE) >= iso GROUP BY k"))
def occupancy_slices(spark, d):
    _, grid, voxels = field(spark, d, FIELD)
    return stats.occupancy_slices(voxels, iso_of(voxels, grid))


@query(o.sql(*_FIELD, select="SELECT CAST(k // 8 AS INTEGER) AS slab, count(*) AS n, count(*) FILTER (density > 0) AS non_zero, round(max(CAST(density AS DOUBLE)), 5) AS max_density, round(sum(CAST(density AS DOUBLE)), 3) AS total FROM vox GROUP BY 1"))
def slab_stats(spark, d):
    _, grid, voxels = field(spark, d, FIELD)
    out = stats.slab_stats(voxels, grid, 8)
    return out.select("slab", "n", "non_zero", F.round("max_density", 5).alias("max_density"), F.round("total", 3).alias("total"))


_OCC = "occ AS (SELECT i, j, k FROM vox, auto WHERE CAST(density AS DOUBLE) >= iso)"
_AROUND = " UNION ALL ".join(f"SELECT i + {a} AS i, j + {b} AS j, k + {c} AS k FROM occ" for a, b, c in repair.STEPS)


_DENOISED = f"around AS (SELECT i, j, k, count(*) AS near FROM ({_AROUND}) GROUP BY 1, 2, 3), both_ AS (SELECT coalesce(o.i, a.i) AS i, coalesce(o.j, a.j) AS j, coalesce(o.k, a.k) AS k, o.i IS NOT NULL AS own, coalesce(near, 0) AS near FROM occ o FULL JOIN around a ON o.i = a.i AND o.j = a.j AND o.k = a.k)"


@query(o.sql(*_FINE, o.STATS, _OCC, _DENOISED,
             select="SELECT i, j, k FROM both_, grid WHERE CASE WHEN i BETWEEN 1 AND nx - 2 AND j BETWEEN 1 AND ny - 2 AND k BETWEEN 1 AND nz - 2 THEN CASE WHEN own THEN near > 1 ELSE near >= 5 END ELSE own END"))
def denoise(spark, d):
    _, grid, voxels = field(spark, d, FINE)
    return repair.denoise(repair.occupied_points(voxels, grid, iso_of(voxels, grid)), grid)[0].select(*[F.col(c).cast("int") for c in "ijk"])


_EMPTY = "free_ AS (SELECT i, j, k FROM (SELECT i, j, k FROM range((SELECT nx FROM grid)) a(i), range((SELECT ny FROM grid)) b(j), range((SELECT nz FROM grid)) c(k)) ANTI JOIN shell USING (i, j, k))"
_SHELL = "shell AS (SELECT i, j, k FROM vox, auto WHERE CAST(density AS DOUBLE) BETWEEN iso AND iso * 4)"


@query(o.sql(*_FINE, o.STATS, _SHELL, _EMPTY, recursive=" outer_(i, j, k) AS (SELECT free_.i, free_.j, free_.k FROM free_, grid WHERE i IN (0, nx - 1) OR j IN (0, ny - 1) OR k IN (0, nz - 1) UNION SELECT f.i, f.j, f.k FROM outer_ o JOIN free_ f ON abs(o.i - f.i) + abs(o.j - f.j) + abs(o.k - f.k) = 1 AND f.i BETWEEN o.i - 1 AND o.i + 1 AND f.j BETWEEN o.j - 1 AND o.j + 1 AND f.k BETWEEN o.k - 1 AND o.k + 1)",
             select="SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM free_ ANTI JOIN outer_ USING (i, j, k)"))
def enclosed_voids(spark, d):
    """Voids of a shell: the points whose density lies between iso and four times it."""
    _, grid, voxels = field(spark, d, FINE)
    iso = iso_of(voxels, grid)
    shell = voxels.where(F.col("density").cast("double").between(iso, iso * 4)).select("i", "j", "k")
    return repair.enclosed_points(stored(shell, "shell"), grid).select(*[F.col(c).cast("int") for c in "ijk"])


_C = (o.GAUSSIANS, o.BOUNDS, o.grid(COARSE), o.VOXELS, o.STATS)


@query(o.sql(*_C, "every AS (SELECT i, j, k, (k * ny + j) * nx + i AS vid, CASE WHEN i BETWEEN 1 AND nx - 2 AND j BETWEEN 1 AND ny - 2 AND k BETWEEN 1 AND nz - 2 AND coalesce(CAST(v.density AS DOUBLE), 0) >= iso THEN 1 ELSE 0 END AS occ FROM (SELECT i, j, k FROM range((SELECT nx FROM grid)) a(i), range((SELECT ny FROM grid)) b(j), range((SELECT nz FROM grid)) c(k)) p CROSS JOIN grid CROSS JOIN auto LEFT JOIN vox v USING (i, j, k)), seeds AS (SELECT DISTINCT a.i, a.j, a.k FROM every a JOIN every b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 AND a.occ <> b.occ), dist AS (SELECT e.vid, e.i, e.j, e.k, any_value(occ) AS occ, min(abs(e.i - s.i) + abs(e.j - s.j) + abs(e.k - s.k)) AS d FROM every e, seeds s GROUP BY 1, 2, 3, 4)",
             select="SELECT vid, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(CAST(CAST((CASE WHEN occ = 1 THEN 1 ELSE -1 END) * ((CASE WHEN d > 3 THEN 4 ELSE least(4, d + 0.5) END) + (((vid * 1664525 + 1013904223) % 4294967296) % 1024) * 0.0000001) AS FLOAT) AS DOUBLE), 4) AS density FROM dist"))
def signed_distance(spark, d):
    _, grid, voxels = field(spark, d, COARSE)
    return rounded(repair.signed_distance(repair.occupied_points(voxels, grid, iso_of(voxels, grid)), grid, 4), digits=4)


@query(o.sql(*_COARSE[:-1], select="SELECT vid, ia, ib, round(t, 4) AS t, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM verts"))
def edge_vertices(spark, d):
    _, grid, voxels = field(spark, d, COARSE)
    iso = iso_of(voxels, grid)
    v = surface.edge_vertices(surface.crossings(surface.cube_values(voxels, grid, iso), grid, iso), grid, iso)
    return v.select("vid", "ia", "ib", F.round("t", 4).alias("t"), *[F.round(c, 5).alias(c) for c in "xyz"])


@query(o.sql(*_COARSE[:-1], select="SELECT CAST(t AS INTEGER) AS t, CAST(code AS INTEGER) AS code, count(*) AS n FROM tets WHERE code BETWEEN 1 AND 14 GROUP BY 1, 2"))
def tetrahedron_cases(spark, d):
    _, grid, voxels = field(spark, d, COARSE)
    iso = iso_of(voxels, grid)
    rows = surface.crossings(surface.cube_values(voxels, grid, iso), grid, iso).where("slot = 0")
    return rows.groupBy((F.col("tet_id") % 8).cast("int").alias("t"), "code").agg(F.count("*").alias("n"))


@query(o.sql(*_COARSE[:-1], select="SELECT p AS vid, round(gx, 4) AS gx, round(gy, 4) AS gy, round(gz, 4) AS gz FROM grad"))
def gradient(spark, d):
    _, grid, voxels = field(spark, d, COARSE)
    iso = iso_of(voxels, grid)
    v = surface.edge_vertices(surface.crossings(surface.cube_values(voxels, grid, iso), grid, iso), grid, iso)
    ends = v.select(F.col("ia").alias("vid")).unionByName(v.select(F.col("ib").alias("vid"))).distinct()
    return rounded(surface.gradients(ends, voxels, grid), digits=4)


@query(o.sql(*_COARSE, select="SELECT fid, a, b, c FROM faces"))
def mesh_faces(spark, d):
    return surface_of(spark, d)[0].faces


@query(o.sql(*_COARSE, select="SELECT vid, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM vertices"))
def mesh_vertices(spark, d):
    return rounded(surface_of(spark, d)[0].vertices.select("vid", "x", "y", "z"), digits=5)


@query(o.sql(*_COARSE, "sums AS (SELECT vid, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM (SELECT a AS vid, fx, fy, fz FROM shaped UNION ALL SELECT b, fx, fy, fz FROM shaped UNION ALL SELECT c, fx, fy, fz FROM shaped) GROUP BY 1)",
             select="SELECT vid, round(CASE WHEN fx * fx + fy * fy + fz * fz > 0 THEN fx / sqrt(fx * fx + fy * fy + fz * fz) ELSE 0 END, 3) AS nx, round(CASE WHEN fx * fx + fy * fy + fz * fz > 0 THEN fy / sqrt(fx * fx + fy * fy + fz * fz) ELSE 0 END, 3) AS ny, round(CASE WHEN fx * fx + fy * fy + fz * fz > 0 THEN fz / sqrt(fx * fx + fy * fy + fz * fz) ELSE 1 END, 3) AS nz FROM sums"))
def vertex_normals(spark, d):
    return rounded(surface_of(spark, d)[0].vertices.select("vid", "nx", "ny", "nz"), digits=3)


_NEAR = o.d2("v.x - ga.x", "v.y - ga.y", "v.z - ga.z")


@query(o.sql(*_COARSE, f"w AS (SELECT v.vid, opacity * exp(-0.5 * {_NEAR}) AS w, cr, cg, cb FROM verts v, ga WHERE {_NEAR} <= {SIGMA * SIGMA}), mean AS (SELECT vid, sum(w) AS s, sum(w * cr) / sum(w) AS cr, sum(w * cg) / sum(w) AS cg, sum(w * cb) / sum(w) AS cb FROM w GROUP BY 1)",
             select="SELECT verts.vid, round(CASE WHEN s > 0.000001 THEN cr ELSE 0.55 END, 4) AS cr, round(CASE WHEN s > 0.000001 THEN cg ELSE 0.58 END, 4) AS cg, round(CASE WHEN s > 0.000001 THEN cb ELSE 0.62 END, 4) AS cb FROM verts LEFT JOIN mean USING (vid)"))
def vertex_colors(spark, d):
    return rounded(surface_of(spark, d, colored=True)[0].vertices.select("vid", "cr", "cg", "cb"), digits=4)


@query(o.sql(*_COARSE, select="SELECT multiplicity, count(*) AS edges FROM (SELECT count(*) AS multiplicity FROM sides GROUP BY least(u, v), greatest(u, v)) GROUP BY 1"))
def edge_multiplicity(spark, d):
    return mesh.edge_multiplicity(surface_of(spark, d)[0].faces)


@query(o.sql(*_COARSE, select="SELECT count(*) AS degenerate FROM shaped WHERE fx * fx + fy * fy + fz * fz <= 2.220446049250313e-16"))
def degenerate_faces(spark, d):
    return mesh.degenerate_faces(surface_of(spark, d)[0]).agg(F.count("*").alias("degenerate"))


_BY_VERTEX = " reach(vid, low) AS (SELECT vid, vid FROM vertices UNION SELECT n.near, r.low FROM reach r JOIN nb n ON n.vid = r.vid WHERE n.near > r.low), comp AS (SELECT vid, min(low) AS component FROM reach GROUP BY 1)"


@query(o.sql(*_COARSE, recursive=_BY_VERTEX, select="SELECT fid, component FROM faces JOIN comp ON comp.vid = a"))
def components_by_vertex(spark, d):
    return mesh.components_by_vertex(surface_of(spark, d)[0].faces)


@query(o.sql(*_COARSE, "twins AS (SELECT DISTINCT p.fid AS a, q.fid AS b FROM sides p JOIN sides q ON least(p.u, p.v) = least(q.u, q.v) AND greatest(p.u, p.v) = greatest(q.u, q.v) AND p.fid <> q.fid)", recursive=" reach(fid, low) AS (SELECT fid, fid FROM faces UNION SELECT t.b, r.low FROM reach r JOIN twins t ON t.a = r.fid WHERE t.b > r.low)", select="SELECT fid, min(low) AS component FROM reach GROUP BY 1"))
def components_by_edge(spark, d):
    return mesh.components_by_edge(surface_of(spark, d)[0].faces)


@query(o.sql(*_COARSE, recursive=_BY_VERTEX + ", sizes AS (SELECT component, count(*) AS n, min(fid) AS first_face FROM faces JOIN comp ON comp.vid = a GROUP BY 1)", select="SELECT component, n AS faces FROM sizes ORDER BY n DESC, first_face LIMIT 1"))
def largest_component(spark, d):
    m = surface_of(spark, d)[0]
    keep = mesh.kept_faces(m.faces, keep_largest=True, min_faces=1)
    return keep.agg(F.min(F.least("a", "b", "c")).alias("component"), F.count("*").alias("faces"))


_KEPT = _BY_VERTEX + ", sizes AS (SELECT component, count(*) AS n FROM faces JOIN comp ON comp.vid = a GROUP BY 1 HAVING count(*) >= 24), kept AS (SELECT faces.* FROM faces JOIN comp ON comp.vid = a SEMI JOIN sizes USING (component)), used AS (SELECT a AS vid FROM kept UNION SELECT b FROM kept UNION SELECT c FROM kept), ids AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM used)"


@query(o.sql(*_COARSE, recursive=_KEPT, select="SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, p.new AS a, q.new AS b, r.new AS c FROM kept JOIN ids p ON p.vid = a JOIN ids q ON q.vid = b JOIN ids r ON r.vid = c"))
def compact_ids(spark, d):
    m = surface_of(spark, d)[0]
    return mesh.compacted(surface.Mesh(m.vertices, mesh.kept_faces(m.faces, keep_largest=False, min_faces=24))).faces


def _pass(source: str, name: str) -> str:
    return f"{name} AS (SELECT v.vid, " + ", ".join(f"CAST(CAST(coalesce(v.{c} + (m.{c} - v.{c}) * 0.{'33' if name == 'p1' else '34'}, v.{c}) AS FLOAT) AS DOUBLE) AS {c}" for c in "xyz") + f" FROM {source} v LEFT JOIN (SELECT nb.vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nb JOIN {source} s ON s.vid = near GROUP BY 1) m USING (vid))"


@query(o.sql(*_COARSE, _pass("vertices", "p1"), _pass("p1", "p2"), select="SELECT vid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM p2"))
def smoothed(spark, d):
    return rounded(mesh.smooth(surface_of(spark, d)[0], 1).vertices.select("vid", "x", "y", "z"), digits=4)


_CLUSTER = "total AS (SELECT count(*) AS n, greatest(4, floor(count(*) * 0.3)) AS target, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vertices), cells AS (SELECT *, greatest(2, ceil(round(pow(target * 2, 1 / 3.0::DOUBLE), 9))) AS cells FROM total), keyed AS MATERIALIZED (SELECT vid, x, y, z, " + ", ".join(f"least(cells - 1, floor(({c} - {c}0) / greatest({c}1 - {c}0, 0.000001) * cells)) AS q{c}" for c in "xyz") + " FROM vertices, cells), clusters AS MATERIALIZED (SELECT qx, qy, qz, min(vid) AS to_, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM keyed GROUP BY 1, 2, 3), moved AS MATERIALIZED (SELECT vid, to_ FROM keyed JOIN clusters USING (qx, qy, qz)), mapped AS MATERIALIZED (SELECT fid, p.to_ AS a, q.to_ AS b, r.to_ AS c FROM faces JOIN moved p ON p.vid = a JOIN moved q ON q.vid = b JOIN moved r ON r.vid = c), single AS MATERIALIZED (SELECT * FROM mapped WHERE len(list_distinct([a, b, c])) = 3 QUALIFY row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY fid) = 1), used AS (SELECT a AS vid FROM single UNION SELECT b FROM single UNION SELECT c FROM single), ids AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM used)"


@query(o.sql(*_COARSE, _CLUSTER, select="SELECT new AS vid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ids JOIN clusters ON to_ = vid"))
def cluster_decimated(spark, d):
    return rounded(decimate.cluster_decimate(surface_of(spark, d)[0], 0.3).vertices.select("vid", "x", "y", "z"), digits=4)


@query(o.sql(*_COARSE, _CLUSTER, select="SELECT fid, a, b, c FROM single"))
def face_dedup(spark, d):
    return _clustered(spark, d)[1]


def _clustered(spark: SparkSession, d: str) -> tuple[surface.Mesh, DataFrame]:
    m = surface_of(spark, d)[0]
    return m, mesh.remapped(m.faces, decimate.cluster_targets(m, 0.3))


_NORMAL = "plane AS (SELECT a, b, c, fx / l AS p0, fy / l AS p1, fz / l AS p2, -(fx / l * px + fy / l * py + fz / l * pz) AS p3 FROM (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS l FROM shaped) WHERE l > 0 UNION ALL SELECT a, b, c, 0, 0, 1, -pz FROM shaped WHERE fx = 0 AND fy = 0 AND fz = 0), corners3 AS (SELECT a AS vid, p0, p1, p2, p3 FROM plane UNION ALL SELECT b, p0, p1, p2, p3 FROM plane UNION ALL SELECT c, p0, p1, p2, p3 FROM plane)"
# Sums of a plane's products, in the order of a symmetric matrix's upper rows.
_PLANES = ("sum(p0 * p0)", "sum(p0 * p1)", "sum(p0 * p2)", "sum(p0 * p3)", "sum(p1 * p1)", "sum(p1 * p2)", "sum(p1 * p3)", "sum(p2 * p2)", "sum(p2 * p3)", "sum(p3 * p3)")


@query(o.sql(*_COARSE, _NORMAL, select="SELECT vid, " + ", ".join(f"round({q}, 3) AS q{k}" for k, q in enumerate(_PLANES)) + " FROM corners3 GROUP BY vid"))
def vertex_quadrics(spark, d):
    return rounded(decimate.vertex_quadrics(surface_of(spark, d)[0]), digits=3)


#: The point of least error through the inverse of the upper 3 x 3 block: its cofactors, determinant, and point.
_SOLVE = """*, q4 * q7 - q5 * q5 AS c00, q2 * q5 - q1 * q7 AS c01, q1 * q5 - q2 * q4 AS c02, q0 * q7 - q2 * q2 AS c11, q1 * q2 - q0 * q5 AS c12, q0 * q4 - q1 * q1 AS c22,
  q0 * (q4 * q7 - q5 * q5) - q1 * (q1 * q7 - q2 * q5) + q2 * (q1 * q5 - q2 * q4) AS det"""
_POINT = """*, CASE WHEN abs(det) >= 1e-12 THEN -(c00 * q3 + c01 * q6 + c02 * q8) / det ELSE mx END AS px,
  CASE WHEN abs(det) >= 1e-12 THEN -(c01 * q3 + c11 * q6 + c12 * q8) / det ELSE my END AS py, CASE WHEN abs(det) >= 1e-12 THEN -(c02 * q3 + c12 * q6 + c22 * q8) / det ELSE mz END AS pz"""
_ERROR = "px * (q0 * px + q1 * py + q2 * pz + q3) + py * (q1 * px + q4 * py + q5 * pz + q6) + pz * (q2 * px + q5 * py + q7 * pz + q8) + q3 * px + q6 * py + q8 * pz + q9"
_SUMS = "quads AS MATERIALIZED (SELECT vid, " + ", ".join(f"{q} AS q{k}" for k, q in enumerate(_PLANES)) + " FROM corners3 GROUP BY vid), pairs AS (SELECT lo AS a, hi AS b, " + ", ".join(f"p.q{k} + r.q{k} AS q{k}" for k in range(10)) + ", " + ", ".join(f"(v.{c} + w.{c}) / 2 AS m{c}" for c in "xyz") + f" FROM links JOIN quads p ON p.vid = lo JOIN quads r ON r.vid = hi JOIN vertices v ON v.vid = lo JOIN vertices w ON w.vid = hi), best AS MATERIALIZED (SELECT {_POINT} FROM (SELECT {_SOLVE} FROM pairs))"


@query(o.sql(*_COARSE, _NORMAL, _SUMS, select=f"SELECT a, b, round({_ERROR}, 5) AS cost FROM best"), order=("cost", "a", "b"))
def quadric_edge_costs(spark, d):
    """Every edge and its cost, in the order of merges."""
    m = surface_of(spark, d)[0]
    return rounded(decimate.edge_costs(m, stored(decimate.vertex_quadrics(m), "quadrics")), digits=5)


#: One edge after another: ``labels`` has each vertex's cluster, ``left_`` the merges that remain.
_MERGE = f" total AS (SELECT count(*) AS n, count(*) - greatest(4, CAST(floor(count(*) * 0.5) AS BIGINT)) AS merges FROM vertices), listed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY round({_ERROR}, 12), a, b) AS i, a + 1 AS a, b + 1 AS b FROM best), run(i, labels, left_) AS (SELECT 0::BIGINT, range(n), merges FROM total UNION ALL SELECT p.i, CASE WHEN labels[p.a] = labels[p.b] THEN labels ELSE [CASE WHEN l = greatest(labels[p.a], labels[p.b]) THEN least(labels[p.a], labels[p.b]) ELSE l END FOR l IN labels] END, left_ - CAST(labels[p.a] <> labels[p.b] AS BIGINT) FROM run JOIN listed p ON p.i = run.i + 1 WHERE left_ > 0), last_ AS MATERIALIZED (SELECT labels FROM run ORDER BY i DESC LIMIT 1), moved AS MATERIALIZED (SELECT v AS vid, labels[v + 1] AS to_ FROM last_, range((SELECT n FROM total)) r(v)), mapped AS MATERIALIZED (SELECT fid, p.to_ AS a, q.to_ AS b, r.to_ AS c FROM faces JOIN moved p ON p.vid = a JOIN moved q ON q.vid = b JOIN moved r ON r.vid = c), single AS MATERIALIZED (SELECT * FROM mapped WHERE len(list_distinct([a, b, c])) = 3 QUALIFY row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY fid) = 1), used AS (SELECT a AS vid FROM single UNION SELECT b FROM single UNION SELECT c FROM single), ids AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM used)"
_MERGED = ", whole AS (SELECT to_, count(*) AS n, " + ", ".join(f"sum(q{k}) AS q{k}" for k in range(10)) + f", avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM moved JOIN quads USING (vid) JOIN vertices USING (vid) GROUP BY to_), placed_ AS (SELECT {_POINT} FROM (SELECT {_SOLVE} FROM whole))"


@query(o.sql(*_COARSE, _NORMAL, _SUMS, recursive=_MERGE + _MERGED, select="SELECT new AS vid, " + ", ".join(f"round(CASE WHEN n = 1 THEN m{c} WHEN n = 2 OR abs(det) > 1e-9 THEN p{c} END, 3) AS {c}" for c in "xyz") + " FROM ids JOIN placed_ ON to_ = vid"))
def quadric_decimated(spark, d):
    """Vertices of the decimated surface; no position where the order of merges within a cluster would decide (SQL can't
    replay it, the tests do)."""
    m = surface_of(spark, d)[0]
    out = decimate.quadric_decimate(m, 0.5)
    return rounded(out.vertices.select("vid", "x", "y", "z"), digits=3)


@query(o.sql(*_COARSE, _NORMAL, _SUMS, recursive=_MERGE, select="SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, p.new AS a, q.new AS b, r.new AS c FROM single JOIN ids p ON p.vid = a JOIN ids q ON q.vid = b JOIN ids r ON r.vid = c"))
def quadric_faces(spark, d):
    return decimate.quadric_decimate(surface_of(spark, d)[0], 0.5).faces


@query()
def quadric_topology(spark, d):
    """Decimation at a preset's resolution: topology and counts."""
    m = decimate.quadric_decimate(surface_of(spark, d, PRESET)[0], 0.5)
    return mesh.topology(m).crossJoin(m.faces.agg(F.count("*").alias("faces"))).crossJoin(m.vertices.agg(F.count("*").alias("vertices")))


def _loose(spark: SparkSession, d: str) -> tuple[surface.Mesh, DataFrame]:
    """The surface, and its faces after clustering: these leave edges with one face."""
    m, faces = _clustered(spark, d)
    return m, stored(faces, "loose")


_LOOSE = "loose AS (SELECT a AS u, b AS v FROM single UNION ALL SELECT b, c FROM single UNION ALL SELECT c, a FROM single), rim AS MATERIALIZED (SELECT u, v FROM loose QUALIFY count(*) OVER (PARTITION BY least(u, v), greatest(u, v)) = 1)"
_LOOPS = " ways AS (SELECT u, count(*) AS w FROM rim GROUP BY u), walk(loop, second, pos, vid, low) AS (SELECT u, v, 1, v, least(u, v) FROM rim UNION ALL SELECT loop, second, pos + 1, rim.v, least(low, rim.v) FROM walk JOIN rim ON rim.u = walk.vid JOIN ways ON ways.u = walk.vid AND w = 1 WHERE walk.vid <> loop AND pos < 64), closed AS (SELECT loop, second FROM walk JOIN ways ON ways.u = loop WHERE vid = loop AND pos >= 3 AND (w > 1 OR low = loop))"


@query(o.sql(*_COARSE, _CLUSTER, _LOOSE, select="SELECT u, v FROM rim"))
def boundary_edges(spark, d):
    return holes.boundary_edges(_loose(spark, d)[1])


@query(o.sql(*_COARSE, _CLUSTER, _LOOSE, recursive=_LOOPS, select="SELECT loop, second, CAST(0 AS BIGINT) AS pos, loop AS vid FROM closed UNION ALL SELECT loop, second, CAST(pos AS BIGINT), vid FROM walk JOIN closed USING (loop, second) WHERE vid <> loop"))
def hole_loops(spark, d):
    return holes.hole_loops(_loose(spark, d)[1], 64)


@query(o.sql(*_COARSE, _CLUSTER, _LOOSE, recursive=_LOOPS + ", fan AS (SELECT loop, second, vid, coalesce(lead(vid) OVER (PARTITION BY loop, second ORDER BY pos), loop) AS ahead FROM (SELECT loop, second, 0 AS pos, loop AS vid FROM closed UNION ALL SELECT loop, second, pos, vid FROM walk JOIN closed USING (loop, second) WHERE vid <> loop)), filled AS (SELECT u, v FROM (SELECT least(u, v) AS u, greatest(u, v) AS v FROM loose UNION ALL SELECT least(vid, ahead), greatest(vid, ahead) FROM fan))",
             select="SELECT (SELECT count(*) FROM closed) AS filled, (SELECT count(*) FROM single) + (SELECT count(*) FROM fan) AS faces, (SELECT count(*) FROM (SELECT 1 FROM filled GROUP BY u, v HAVING count(*) = 1)) AS boundary_edges"))
def holes_filled(spark, d):
    m, faces = _loose(spark, d)
    capped, n = holes.fill_holes(surface.Mesh(m.vertices, faces), 64)
    rim = holes.boundary_edges(capped.faces).agg(F.count("*").alias("boundary_edges"))
    return capped.faces.agg(F.count("*").alias("faces")).crossJoin(rim).select(F.lit(n).cast("bigint").alias("filled"), "faces", "boundary_edges")  # one row each


@query(o.sql(*_COARSE, select="SELECT count(*) AS vertices FROM (SELECT DISTINCT floor(x / greatest(0.0000001, sp * 0.00001) + 0.5), floor(y / greatest(0.0000001, sp * 0.00001) + 0.5), floor(z / greatest(0.0000001, sp * 0.00001) + 0.5) FROM vertices, grid)"))
def welded(spark, d):
    m, grid = surface_of(spark, d)
    twice = m.vertices.select(F.explode(F.array(F.col("vid") * 2, F.col("vid") * 2 + 1)).alias("vid"), *[c for c in m.vertices.columns if c != "vid"])
    apart = surface.Mesh(twice, m.faces.select("fid", *[(F.col(p) * 2 + F.col("fid") % 2).alias(p) for p in "abc"]))  # faces in turn, as from two slabs
    return mesh.weld(apart, grid.spacing).vertices.agg(F.count("*").alias("vertices"))


@query(o.sql(*_COARSE, recursive=" reach(fid, low) AS (SELECT fid, fid FROM faces UNION SELECT t.b, r.low FROM reach r JOIN (SELECT DISTINCT p.fid AS a, q.fid AS b FROM sides p JOIN sides q ON least(p.u, p.v) = least(q.u, q.v) AND greatest(p.u, p.v) = greatest(q.u, q.v) AND p.fid <> q.fid) t ON t.a = r.fid WHERE t.b > r.low), comp AS (SELECT fid, min(low) AS component FROM reach GROUP BY 1), mult AS (SELECT count(*) AS m FROM sides GROUP BY least(u, v), greatest(u, v))",
             select="SELECT (SELECT count(*) FROM mult WHERE m = 1) AS boundary_edges, (SELECT count(*) FROM mult WHERE m > 2) AS non_manifold_edges, (SELECT count(*) FROM shaped WHERE fx * fx + fy * fy + fz * fz <= 2.220446049250313e-16) AS degenerate_faces, (SELECT count(DISTINCT component) FROM comp) AS components"))
def topology(spark, d):
    return mesh.topology(surface_of(spark, d)[0])


@query(o.sql(*_COARSE, "rated AS (SELECT greatest(s0, s1, s2) / least(s0, s1, s2) AS v FROM ga), l AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM rated)", recursive=_BY_VERTEX + ", sizes AS (SELECT component, count(*) AS n, min(fid) AS first_face FROM faces JOIN comp ON comp.vid = a GROUP BY 1 ORDER BY n DESC, first_face LIMIT 1), main AS (SELECT faces.* FROM faces JOIN comp ON comp.vid = a SEMI JOIN (SELECT component FROM sizes WHERE n >= 16) USING (component))",
             select=f"SELECT 'all' AS mode, (SELECT count(*) FROM act) AS source, n AS opacity_retained, n AS case_retained, round(l[{o._rank(0.95)}], 6) AS ratio_p95, round(l[{o._rank(0.99)}], 6) AS ratio_p99, round(l[n], 6) AS ratio_max, CAST({COARSE} AS INTEGER) AS resolution, CAST(nx AS INTEGER) AS nx, CAST(ny AS INTEGER) AS ny, CAST(nz AS INTEGER) AS nz, nx * ny * nz AS voxels, round(max_density, 5) AS density_max, non_zero AS density_non_zero, round(iso, 5) AS iso, (SELECT count(*) FROM faces) AS raw_triangles, (SELECT count(DISTINCT v) FROM (SELECT unnest([a, b, c]) AS v FROM main)) AS vertices, (SELECT count(*) FROM main) AS triangles FROM l, grid, stats, auto"))
def inspection(spark, d):
    out = diagnostics.inspection(scene(spark, d).every, resolution=COARSE)
    return out.select(*out.columns[:4], *[F.round(c, 6).alias(c) for c in ("ratio_p95", "ratio_p99", "ratio_max")], *out.columns[7:12], F.round("density_max", 5).alias("density_max"), "density_non_zero", F.round("iso", 5).alias("iso"), "raw_triangles", "vertices", "triangles")


@query()
def conversion(spark, d):
    """The whole conversion with repairs: one row of counts and topology."""
    from ..params import Params
    from ..session import SplatSession

    s = SplatSession(spark)
    try:
        s.load_raw(raw_from_embeddings(spark, f"{d}/embeddings.parquet"), "parquet")
        out = s.start(Params(resolution=PRESET, min_component_faces=8, denoise=1, fill_voids=True, max_hole_edges=8, decimation_ratio=0.6))
        row = (out.iso, out.mesh.vertices.count(), out.mesh.faces.count(), *out.quality.first())
    finally:
        s.dispose()
    return spark.createDataFrame([row], "iso double, vertices bigint, faces bigint, boundary_edges bigint, non_manifold_edges bigint, degenerate_faces bigint, components bigint")


@scoped
def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(field(spark, sf_dir, 24)[2])
