"""Operators on meshes: normals, topology, components, compaction, smoothing, welding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .dense import dense_ids, first_of
from .graph import connected_components
from .surface import Mesh, unit

#: Twice the area of a face, squared, up to which it counts as degenerate: the spacing of doubles at 1.
DEGENERATE = 2.0**-52


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid, a, b, c and the corners' positions xa, ya, za, xb, ..."""
    out = faces.select("fid", "a", "b", "c")
    for p in "abc":
        out = out.join(vertices.select(F.col("vid").alias(p), *[F.col(c).alias(c + p) for c in "xyz"]), p)
    return out


def cross_sql() -> list[str]:
    """The face's normal, twice its area long, from with_corners."""
    u, v = [f"({c}b - {c}a)" for c in "xyz"], [f"({c}c - {c}a)" for c in "xyz"]
    return [f"({u[(k + 1) % 3]} * {v[(k + 2) % 3]} - {u[(k + 2) % 3]} * {v[(k + 1) % 3]})" for k in range(3)]


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid, nx, ny, nz: the faces' normals by area; (0, 0, 1) without any."""
    n = with_corners(faces, vertices).select(F.explode(F.array("a", "b", "c")).alias("vid"), *[F.expr(sql).alias(f"f{c}") for sql, c in zip(cross_sql(), "xyz", strict=True)])
    sums = n.groupBy("vid").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"])
    full = vertices.select("vid").join(sums, "vid", "left").select("vid", *[F.coalesce(f"f{c}", F.lit(0.0)).alias(f"f{c}") for c in "xyz"])
    return full.select("vid", *unit("fx", "fy", "fz", ("nx", "ny", "nz")))


def renormaled(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    rest = [c for c in vertices.columns if c not in ("nx", "ny", "nz")]
    return vertices.select(*rest).join(vertex_normals(vertices, faces), "vid").select(*vertices.columns)


def face_edges(faces: DataFrame) -> DataFrame:
    """fid, u, v (as wound), lo, hi of each side of each face."""
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "bc", "ca")])
    return faces.select("fid", F.explode(sides).alias("s")).select("fid", "s.u", "s.v", F.least("s.u", "s.v").alias("lo"), F.greatest("s.u", "s.v").alias("hi"))


def undirected_edges(faces: DataFrame) -> DataFrame:
    return face_edges(faces).select("lo", "hi").distinct()


def edge_multiplicity(faces: DataFrame) -> DataFrame:
    """multiplicity and edges: how many edges have so many faces (1: boundary, more than 2: not manifold)."""
    return face_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("multiplicity")).groupBy("multiplicity").agg(F.count("*").alias("edges"))


def degenerate_faces(mesh: Mesh) -> DataFrame:
    """Faces that repeat a vertex or have no area: fid."""
    n = cross_sql()
    return with_corners(mesh.faces, mesh.vertices).where(F.expr(f"a = b OR b = c OR c = a OR {n[0]} * {n[0]} + {n[1]} * {n[1]} + {n[2]} * {n[2]} <= {DEGENERATE!r}D")).select("fid")


def components_by_vertex(faces: DataFrame) -> DataFrame:
    """fid and component (the least vertex) of faces that share vertices."""
    edges = undirected_edges(faces)
    parts = connected_components(edges, "lo", "hi")
    return faces.select("fid", F.col("a").alias("id")).join(parts, "id", "left").select("fid", F.coalesce("component", "id").alias("component"))


def components_by_edge(faces: DataFrame) -> DataFrame:
    """fid and component (the least face) of faces that share edges."""
    sides = face_edges(faces)
    first = sides.groupBy("lo", "hi").agg(F.min("fid").alias("first"))
    links = sides.join(first, ["lo", "hi"]).select(F.col("fid").alias("a"), F.col("first").alias("b"))
    parts = connected_components(links)
    return faces.select("fid").join(parts, F.col("fid") == F.col("id"), "left").select("fid", F.coalesce("component", "fid").alias("component"))


def topology(mesh: Mesh) -> DataFrame:
    """One row: boundary_edges, non_manifold_edges, degenerate_faces, components."""
    edges = edge_multiplicity(mesh.faces).agg(F.coalesce(F.sum(F.when(F.col("multiplicity") == 1, F.col("edges"))), F.lit(0)).alias("boundary_edges"), F.coalesce(F.sum(F.when(F.col("multiplicity") > 2, F.col("edges"))), F.lit(0)).alias("non_manifold_edges"))
    flat = degenerate_faces(mesh).agg(F.count("*").alias("degenerate_faces"))
    parts = components_by_edge(mesh.faces).agg(F.count_distinct("component").alias("components"))
    return edges.crossJoin(flat).crossJoin(parts)  # one row each


def kept_faces(faces: DataFrame, *, keep_largest: bool, min_faces: int) -> DataFrame:
    """Faces of components (by shared vertex) of at least ``min_faces`` faces; with ``keep_largest`` only of the
    largest, of equals that with the first face.  If that one is too small, none."""
    parts = stored(components_by_vertex(faces), "components")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"), F.min("fid").alias("first"))
    if keep_largest:
        sizes = sizes.orderBy(F.desc("n"), "first").limit(1)
    keep = sizes.where(F.col("n") >= max(1, min_faces)).select("component")
    return faces.join(parts, "fid").join(keep, "component", "left_semi").select("fid", "a", "b", "c")


def compacted(mesh: Mesh) -> Mesh:
    """Without vertices that no face uses; vertices and faces numbered anew in their old order."""
    used = mesh.faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    v = stored(dense_ids(mesh.vertices.join(used, "vid", "left_semi"), "vid", "new"), "compacted")
    f = mesh.faces
    for p in "abc":
        f = f.join(v.select(F.col("vid").alias(p), F.col("new").alias(f"_{p}")), p)
    f = dense_ids(f.select("fid", *[F.col(f"_{p}").alias(p) for p in "abc"]), "fid", "_f").select(F.col("_f").alias("fid"), "a", "b", "c")
    names = [c for c in mesh.vertices.columns if c != "vid"]
    return Mesh(v.select(F.col("new").alias("vid"), *names), stored(f, "compacted-faces"))


def smooth(mesh: Mesh, iterations: int, *, classic: bool = False) -> Mesh:
    """Two passes of neighbour averages per iteration, each towards the average; ``classic`` turns the second pass
    away from it."""
    links = stored(undirected_edges(mesh.faces), "edges")
    links = stored(links.select(F.col("lo").alias("vid"), F.col("hi").alias("near")).unionByName(links.select(F.col("hi").alias("vid"), F.col("lo").alias("near"))), "neighbours")
    v = mesh.vertices
    for _ in range(min(10, iterations)):
        for factor in (0.33, -0.34 if classic else 0.34):
            near = links.join(v.select(F.col("vid").alias("near"), "x", "y", "z"), "near").groupBy("vid").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
            moved = [F.coalesce(F.col(c) + (F.col(f"m{c}") - F.col(c)) * factor, F.col(c)).cast("float").cast("double").alias(c) for c in "xyz"]
            rest = [c for c in v.columns if c not in "xyz"]
            v = stored(v.join(near, "vid", "left").select(*rest, *moved).select(*mesh.vertices.columns), "smoothed")
    return Mesh(v, mesh.faces)


def cleanup(mesh: Mesh, *, keep_largest: bool, min_faces: int, smoothing: int, classic: bool = False) -> Mesh:
    """Small components out, numbers dense, then smoothing with new normals."""
    if mesh.faces.isEmpty():
        return mesh
    faces = stored(kept_faces(mesh.faces, keep_largest=keep_largest, min_faces=min_faces), "kept-faces")
    out = compacted(Mesh(mesh.vertices, faces))
    if smoothing > 0 and not out.faces.isEmpty():
        out = smooth(out, smoothing, classic=classic)
        out = Mesh(stored(renormaled(out.vertices, out.faces), "renormaled"), out.faces)
    return out


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Of faces with the same vertices the first, as it was wound; faces that repeat a vertex are gone."""
    own = faces.where("a != b AND b != c AND c != a").withColumn("_key", F.sort_array(F.array("a", "b", "c")))
    return first_of(own, ["_key"], "fid").select("fid", "a", "b", "c")


def remapped(faces: DataFrame, new: DataFrame) -> DataFrame:
    """Faces over ``new`` (vid, to), without repeated ones."""
    f = faces
    for p in "abc":
        f = f.join(new.select(F.col("vid").alias(p), F.col("to").alias(f"_{p}")), p)
    return distinct_faces(f.select("fid", *[F.col(f"_{p}").alias(p) for p in "abc"]))


def weld(mesh: Mesh, spacing: float) -> Mesh:
    """Vertices that agree up to a hundred-thousandth of the spacing become the first of them."""
    tolerance = max(1e-7, spacing * 1e-5)
    keys = [F.floor(F.col(c) / tolerance + 0.5).alias(f"q{c}") for c in "xyz"]
    own = mesh.vertices.select("vid", *keys)
    first = own.groupBy("qx", "qy", "qz").agg(F.min("vid").alias("to"))
    new = stored(own.join(first, ["qx", "qy", "qz"]).select("vid", "to"), "welded")
    return compacted(Mesh(mesh.vertices, stored(remapped(mesh.faces, new), "welded-faces")))
