"""Iso-surface by marching tetrahedra, as joins and aggregates over cubes and lattice edges.

Points spread their values to the eight cubes around them; cubes with an occupied corner are cut to six
tetrahedra each, whose edges that cross the threshold become rows.  A vertex is a lattice edge,
numbered by its first crossing; faces look their vertices up by edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian as g
from ..tables import Scratch, stored
from .bounds import EPSILON, Grid
from .dense import dense_ids
from .density import colors_at

# Corners of a cube, and the tetrahedra of a cube as corners.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
TETRAHEDRA = ((0, 5, 1, 6), (0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6))


def crossings_of(inside: tuple[bool, ...]) -> list[tuple[int, int]]:
    """Edges of a tetrahedron (as positions 0 to 3) that the surface crosses, in the order of their numbering."""
    own = [p for p in range(4) if inside[p]]
    other = [p for p in range(4) if not inside[p]]
    if len(own) == 2:
        return [(own[0], other[0]), (own[0], other[1]), (own[1], other[1]), (own[1], other[0])]
    lone, rest = (own[0], other) if len(own) == 1 else (other[0], own) if len(own) == 3 else (0, [])
    return [(lone, p) for p in rest]


def case_rows() -> list[tuple[int, int, int, int, int]]:
    """tet, code (bit p: position p is inside), slot, and the two corners of the slot's crossing."""
    out = []
    for t, tet in enumerate(TETRAHEDRA):
        for code in range(1, 15):
            for slot, (p, q) in enumerate(crossings_of(tuple(bool(code >> b & 1) for b in range(4)))):
                out.append((t, code, slot, tet[p], tet[q]))
    return out


@dataclass(frozen=True)
class Mesh:
    """vertices: vid, x, y, z, nx, ny, nz, cr, cg, cb; faces: fid, a, b, c."""

    vertices: DataFrame
    faces: DataFrame


def dense_field(voxels: DataFrame, grid: Grid, layers: tuple[int, int] | None = None) -> DataFrame:
    """The field with a row for every point of the grid, or of its layers from the first of ``layers`` to before the
    second."""
    nx, ny = grid.dims[0], grid.dims[1]
    lo, hi = layers or (0, grid.dims[2])
    every = voxels.sparkSession.range(lo * nx * ny, hi * nx * ny).withColumnRenamed("id", "vid")
    every = every.select("vid", F.expr(f"CAST(vid % {nx} AS INT)").alias("i"), F.expr(f"CAST((vid DIV {nx}) % {ny} AS INT)").alias("j"), F.expr(f"CAST(vid DIV {nx * ny} AS INT)").alias("k"))
    return every.join(voxels.select("vid", "density"), "vid", "left").select("vid", "i", "j", "k", F.coalesce("density", F.lit(0.0).cast("float")).alias("density"))


def cube_values(voxels: DataFrame, grid: Grid, iso: float, layers: tuple[int, int] | None = None) -> DataFrame:
    """Cubes with an occupied corner: x, y, z and the corners' values v0 to v7; the grid's outer layer reads as just
    outside, absent points as 0."""
    outside = iso - max(EPSILON, abs(iso) * 1e-6)
    if not iso > 0:
        voxels = dense_field(voxels, grid, layers)  # absent points are occupied too
    nx, ny, nz = grid.dims
    border = f"(i = 0 OR j = 0 OR k = 0 OR i = {nx - 1} OR j = {ny - 1} OR k = {nz - 1})"
    value = voxels.select("i", "j", "k", F.expr(f"CASE WHEN {border} THEN {outside!r}D ELSE CAST(density AS DOUBLE) END").alias("v"))
    corners = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(o).alias(c) for o, c in zip(xyz, "xyz", strict=True)]) for n, xyz in enumerate(CORNERS)])
    spread = value.select("i", "j", "k", "v", F.explode(corners).alias("o"))
    spread = spread.select(*[(F.col(p) - F.col(f"o.{c}")).alias(c) for p, c in zip("ijk", "xyz", strict=True)], F.col("o.n").alias("n"), "v")
    spread = spread.where(f"x BETWEEN 0 AND {nx - 2} AND y BETWEEN 0 AND {ny - 2} AND z BETWEEN 0 AND {nz - 2}")
    # a border corner may be absent from a sparse field, and is outside then as well
    def absent(n: int) -> str:
        dx, dy, dz = CORNERS[n]
        at_edge = f"(x + {dx} = 0 OR y + {dy} = 0 OR z + {dz} = 0 OR x + {dx} = {nx - 1} OR y + {dy} = {ny - 1} OR z + {dz} = {nz - 1})"
        return f"CASE WHEN {at_edge} THEN {outside!r}D ELSE 0D END"

    cubes = spread.groupBy("x", "y", "z").agg(*[F.max(F.when(F.col("n") == n, F.col("v"))).alias(f"w{n}") for n in range(8)])
    cubes = cubes.select("x", "y", "z", *[F.coalesce(f"w{n}", F.expr(absent(n))).alias(f"v{n}") for n in range(8)])
    inside = F.lit(False)
    for n in range(8):
        inside = inside | (F.col(f"v{n}") >= iso)
    return cubes.where(inside)


def crossings(cubes: DataFrame, grid: Grid, iso: float) -> DataFrame:
    """A row per crossed edge of a tetrahedron: tet_id (cube and tetrahedron), code, slot, the edge's points ia and ib
    (in crossing order) with their values va and vb."""
    spark = cubes.sparkSession
    tets = F.array(*[F.struct(F.lit(t).alias("t"), sum(((F.col(f"v{c}") >= iso).cast("int") * (1 << b) for b, c in enumerate(tet)), F.lit(0)).alias("code")) for t, tet in enumerate(TETRAHEDRA)])
    values = F.array(*[f"v{n}" for n in range(8)])
    rows = cubes.select("x", "y", "z", values.alias("v"), F.explode(tets).alias("s")).select("x", "y", "z", "v", F.col("s.t").alias("t"), F.col("s.code").alias("code")).where("code BETWEEN 1 AND 14")
    cases = spark.createDataFrame(case_rows(), "t int, code int, slot int, ca int, cb int")
    rows = rows.join(F.broadcast(cases), ["t", "code"])  # 6 * 14 cases of 3 or 4 rows

    def corner(c: str) -> list:
        offset = F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in CORNERS]), F.col(c) + 1)
        return [F.col(axis) + F.get(offset, F.lit(k)) for k, axis in enumerate("xyz")]

    def point(c: str):
        i, j, k = corner(c)
        return ((k * grid.dims[1] + j).cast("bigint") * grid.dims[0] + i).cast("bigint")

    cube = F.expr(grid.vid("x", "y", "z"))
    return rows.select((cube * 8 + F.col("t")).alias("tet_id"), "code", "slot", point("ca").alias("ia"), point("cb").alias("ib"), F.element_at("v", F.col("ca") + 1).alias("va"), F.element_at("v", F.col("cb") + 1).alias("vb"))


def edge_vertices(rows: DataFrame, grid: Grid, iso: float) -> DataFrame:
    """Vertices of the crossings: vid by first crossing, the edge lo, hi, its ends ia, ib in the first crossing's
    order, t along it, and x, y, z."""
    edges = rows.select(F.least("ia", "ib").alias("lo"), F.greatest("ia", "ib").alias("hi"), (F.col("tet_id") * 8 + F.col("slot")).alias("first"), "ia", "ib", "va", "vb")
    edges = edges.groupBy("lo", "hi").agg(F.min("first").alias("first"), F.min_by(F.struct("ia", "ib", "va", "vb"), "first").alias("m")).select("lo", "hi", "first", "m.*")
    t = F.expr(f"CASE WHEN abs(vb - va) > {EPSILON} THEN greatest(0D, least(1D, ({iso!r}D - va) / (vb - va))) ELSE 0.5D END")
    edges = edges.withColumn("t", t)
    nx, ny = grid.dims[0], grid.dims[1]
    for a, (c, index) in enumerate((("x", "({p} % {nx})"), ("y", "(({p} DIV {nx}) % {ny})"), ("z", "({p} DIV {nxy})"))):
        ends = [grid.position(a, index.format(p=p, nx=nx, ny=ny, nxy=nx * ny)) for p in ("ia", "ib")]
        edges = edges.withColumn(c, F.expr(f"{ends[0]} + ({ends[1]} - {ends[0]}) * t"))
    return dense_ids(edges, "first", "vid").drop("first")


def gradients(points: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """``points``: vid.  Central differences of the field, one-sided at the grid's border: vid, gx, gy, gz."""
    nx, ny, nz = grid.dims
    own = points.select("vid", F.expr(f"vid % {nx}").alias("i"), F.expr(f"(vid DIV {nx}) % {ny}").alias("j"), F.expr(f"vid DIV {nx * ny}").alias("k"))
    terms = []
    for a, (c, n) in enumerate((("i", nx), ("j", ny), ("k", nz))):
        step = (1, nx, nx * ny)[a]
        lo, hi = f"greatest(0, {c} - 1)", f"least({n - 1}, {c} + 1)"
        width = f"(greatest(1, {hi} - {lo}) * {grid.spacing!r}D)"
        terms += [f"struct({a} AS axis, vid + ({hi} - {c}) * {step} AS at, 1 / {width} AS f)", f"struct({a} AS axis, vid + ({lo} - {c}) * {step} AS at, -1 / {width} AS f)"]
    near = own.select("vid", F.explode(F.expr(f"array({', '.join(terms)})")).alias("n")).select("vid", "n.axis", "n.at", "n.f")
    values = voxels.select(F.col("vid").alias("at"), F.col("density").cast("double").alias("d"))
    near = near.join(values, "at", "left").withColumn("term", F.col("f") * F.coalesce("d", F.lit(0.0)))
    return near.groupBy("vid").agg(*[F.sum(F.when(F.col("axis") == a, F.col("term")).otherwise(0.0)).alias(f"g{c}") for a, c in enumerate("xyz")])


def unit(x: str, y: str, z: str, names: tuple[str, str, str]) -> list:
    """A vector of length 1, (0, 0, 1) for a zero vector."""
    n = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    return [F.expr(f"CASE WHEN {n} > 0 THEN {c} / {n} ELSE {float(c == z)}D END").alias(name) for c, name in zip((x, y, z), names, strict=True)]


def with_gradient_normals(vertices: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """Vertices with nx, ny, nz: against the interpolated gradient."""
    ends = vertices.select(F.col("ia").alias("vid")).unionByName(vertices.select(F.col("ib").alias("vid"))).distinct()
    grad = stored(gradients(ends, voxels, grid), "gradients")
    side = lambda p: grad.select(F.col("vid").alias(p), *[F.col(f"g{c}").alias(f"{p}{c}") for c in "xyz"])
    both = vertices.join(side("ia"), "ia").join(side("ib"), "ib")
    for c in "xyz":
        both = both.withColumn(f"_g{c}", F.expr(f"-(ia{c} + (ib{c} - ia{c}) * t)"))
    return both.select(*vertices.columns, *unit("_gx", "_gy", "_gz", ("nx", "ny", "nz")))


def triangles(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces of the crossings: order, a, b, c, wound towards the vertices' normals; faces that repeat a vertex are
    left out."""
    known = vertices.select("lo", "hi", F.struct("vid", "x", "y", "z", "nx", "ny", "nz").alias("p"))
    own = rows.select("tet_id", "slot", F.least("ia", "ib").alias("lo"), F.greatest("ia", "ib").alias("hi")).join(known, ["lo", "hi"])
    tets = own.groupBy("tet_id").agg(*[F.max(F.when(F.col("slot") == s, F.col("p"))).alias(f"p{s}") for s in range(4)])
    two = F.when(F.col("p3").isNull(), F.array(F.struct(F.lit(0).alias("n"), *[F.col(f"p{s}").alias(c) for s, c in zip((0, 1, 2), "abc", strict=True)])))
    faces = two.otherwise(F.array(*[F.struct(F.lit(n).alias("n"), *[F.col(f"p{s}").alias(c) for s, c in zip(slots, "abc", strict=True)]) for n, slots in enumerate(((0, 1, 2), (0, 2, 3)))]))
    flat = tets.select("tet_id", F.explode(faces).alias("f")).select((F.col("tet_id") * 2 + F.col("f.n")).alias("order"), "f.a", "f.b", "f.c")
    flat = flat.where("a.vid != b.vid AND b.vid != c.vid AND c.vid != a.vid")
    u = [f"(b.{c} - a.{c})" for c in "xyz"]
    v = [f"(c.{c} - a.{c})" for c in "xyz"]
    facing = " + ".join(f"({u[(k + 1) % 3]} * {v[(k + 2) % 3]} - {u[(k + 2) % 3]} * {v[(k + 1) % 3]}) * (a.n{n} + b.n{n} + c.n{n})" for k, n in enumerate("xyz"))
    turned = F.expr(f"({facing}) < 0")
    return flat.select("order", F.col("a.vid").alias("a"), F.when(turned, F.col("c.vid")).otherwise(F.col("b.vid")).alias("b"), F.when(turned, F.col("b.vid")).otherwise(F.col("c.vid")).alias("c"))


def extract_mesh(voxels: DataFrame, gaussians: DataFrame | None, grid: Grid, iso: float, sigma: float, rows: DataFrame | None = None) -> Mesh:
    """The surface of the field at ``iso``: vertices with positions, area-weighted normals and colors, and faces.
    ``rows``: the crossings, if they have been found otherwise than over the whole field."""
    from .mesh import vertex_normals

    with Scratch(voxels.sparkSession) as scratch:
        rows = scratch.stored(crossings(cube_values(voxels, grid, iso), grid, iso) if rows is None else rows, "crossings")
        bare = scratch.stored(edge_vertices(rows, grid, iso), "edge-vertices")
        normal = scratch.stored(with_gradient_normals(bare, voxels, grid), "gradient-normals")
        faces = stored(dense_ids(triangles(rows, normal), "order", "fid").select("fid", "a", "b", "c"), "faces")
        points = bare.select("vid", *[F.col(c).cast("float").cast("double").alias(c) for c in "xyz"])
        if gaussians is None:
            colors = bare.select("vid", *[F.lit(v).alias(c) for c, v in zip(("cr", "cg", "cb"), g.GRAY, strict=True)])
        else:
            colors = colors_at(bare, gaussians, grid, sigma)
        vertices = points.join(vertex_normals(points, faces), "vid").join(colors, "vid")
        return Mesh(stored(vertices.select("vid", "x", "y", "z", "nx", "ny", "nz", "cr", "cg", "cb"), "vertices"), faces)
