"""Decimation: by clusters of cells, or by quadric errors.

The order of quadric merges never changes while they run: merging along the cheapest edges that join two clusters is a
minimum spanning forest, and stopping early keeps its cheapest edges.  The forest comes in rounds (each component
takes its cheapest edge, and pointers are doubled), its cheapest edges by a sort over ranges, clusters as components,
and what a cluster becomes as grouped sums.  Only where a cluster's quadric has no single best point does the order of
the merges within it matter; such clusters are replayed one by one, each in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Scratch, stored
from .graph import connected_components
from .mesh import Mesh, compacted, cross_sql, remapped, renormaled, undirected_edges, with_corners

# The order of a symmetric 4 x 4 matrix's entries.
ENTRIES = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))


def target_vertices(n: int, ratio: float) -> int:
    return max(4, math.floor(n * max(0.05, min(1.0, ratio))))


def _rebuilt(vertices: DataFrame, faces: DataFrame) -> Mesh:
    """Positions and colors with new normals, without vertices that no face uses."""
    own = vertices.select("vid", *[F.col(c).cast("float").cast("double").alias(c) for c in "xyz"], *[F.lit(0.0).alias(f"n{c}") for c in "xyz"], "cr", "cg", "cb")
    faces = stored(faces, "decimated-faces")
    out = compacted(Mesh(stored(own, "decimated"), faces))
    return Mesh(stored(renormaled(out.vertices, out.faces), "decimated-normals"), out.faces)


def _cells(mesh: Mesh, ratio: float) -> DataFrame:
    """The vertices with their cells qx, qy, qz of a grid over the mesh's box."""
    box = mesh.vertices.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{c}") for c in "xyz" for name, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = max(2, math.ceil(round((target_vertices(box["n"], ratio) * 2) ** (1 / 3), 9)))
    own = mesh.vertices
    for c in "xyz":
        lo, extent = box[f"lo{c}"], max(box[f"hi{c}"] - box[f"lo{c}"], 1e-6)
        own = own.withColumn(f"q{c}", F.least(F.lit(cells - 1), F.floor((F.col(c) - lo) / extent * cells)))
    return own


def cluster_targets(mesh: Mesh, ratio: float) -> DataFrame:
    """vid and to, the first vertex of its cell."""
    own, keys = _cells(mesh, ratio), ["qx", "qy", "qz"]
    return own.select("vid", *keys).join(own.groupBy(*keys).agg(F.min("vid").alias("to")), keys).select("vid", "to")


def cluster_decimate(mesh: Mesh, ratio: float) -> Mesh:
    """Vertices of a cell become their mean; cells are a grid over the mesh's box."""
    n = mesh.vertices.count()
    if target_vertices(n, ratio) >= n or mesh.faces.count() < 2:
        return mesh
    new = stored(cluster_targets(mesh, ratio), "cells")
    clusters = mesh.vertices.join(new, "vid").groupBy("to").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "cr", "cg", "cb")])
    return _rebuilt(clusters.withColumnRenamed("to", "vid"), remapped(mesh.faces, new))


def vertex_quadrics(mesh: Mesh) -> DataFrame:
    """vid and the ten sums q0 to q9 of its faces' planes; a face without area counts as the plane across z."""
    n = cross_sql()
    length = f"sqrt({n[0]} * {n[0]} + {n[1]} * {n[1]} + {n[2]} * {n[2]})"
    own = with_corners(mesh.faces, mesh.vertices).withColumn("_len", F.expr(length))
    own = own.select("fid", "a", "b", "c", "xa", "ya", "za", *[F.expr(f"CASE WHEN _len > 0 THEN {sql} / _len ELSE {float(k == 2)}D END").alias(f"p{k}") for k, sql in enumerate(n)])
    own = own.withColumn("p3", F.expr("-(p0 * xa + p1 * ya + p2 * za)"))
    planes = own.select(F.explode(F.array("a", "b", "c")).alias("vid"), *[F.expr(f"p{i} * p{j}").alias(f"q{k}") for k, (i, j) in enumerate(ENTRIES)])
    sums = planes.groupBy("vid").agg(*[F.sum(f"q{k}").alias(f"q{k}") for k in range(10)])
    return mesh.vertices.select("vid").join(sums, "vid", "left").select("vid", *[F.coalesce(f"q{k}", F.lit(0.0)).alias(f"q{k}") for k in range(10)])


def best_points(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points of least quadric error; the middle of a and b where the error has no single least point."""
    m = np.empty((len(q), 3, 3))
    for k, (i, j) in enumerate(ENTRIES):
        if j < 3:
            m[:, i, j] = m[:, j, i] = q[:, k]
    rhs = -q[:, [3, 6, 8]]
    det = np.linalg.det(m)
    out = (a + b) / 2
    ok = np.abs(det) >= 1e-12
    for axis in range(3):
        swapped = m[ok].copy()
        swapped[:, :, axis] = rhs[ok]
        out[ok, axis] = np.linalg.det(swapped) / det[ok]
    bad = ~np.isfinite(out).all(axis=1)
    out[bad] = (a[bad] + b[bad]) / 2
    return out


def _cost_sql() -> tuple[list[tuple[str, str]], str]:
    """SQL over q0 to q9 (sums of both ends) and their middle mx, my, mz: steps with their names, and the cost at the
    point of Cramer's rule, or at the middle where there is no single point."""
    m = [[f"q{ENTRIES.index((min(i, j), max(i, j)))}" for j in range(4)] for i in range(3)]

    def det(columns: list[list[str]]) -> str:
        (a, d, g), (b, e, h), (c, f, i) = columns
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    columns = [[m[i][j] for i in range(3)] for j in range(3)]
    right = [f"(-{m[i][3]})" for i in range(3)]
    steps = [("det", det(columns))]
    steps += [(f"p{c}", f"CASE WHEN abs(det) >= 1e-12 THEN {det([right if j == k else columns[j] for j in range(3)])} / det ELSE m{c} END") for k, c in enumerate("xyz")]
    point = ["px", "py", "pz", "1"]
    return steps, " + ".join(f"{1 if i == j else 2} * q{k} * {point[i]} * {point[j]}" for k, (i, j) in enumerate(ENTRIES))


def edge_costs(mesh: Mesh, quadrics: DataFrame) -> DataFrame:
    """a < b and cost: the error of the best point for both ends."""
    side = lambda p: quadrics.join(mesh.vertices.select("vid", "x", "y", "z"), "vid").select(F.col("vid").alias(p), *[F.col(c).alias(p + c) for c in (*(f"q{k}" for k in range(10)), "x", "y", "z")])
    both = undirected_edges(mesh.faces).select(F.col("lo").alias("a"), F.col("hi").alias("b")).join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", *[(F.col(f"aq{k}") + F.col(f"bq{k}")).alias(f"q{k}") for k in range(10)], *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(f"m{c}") for c in "xyz"])
    steps, cost = _cost_sql()
    for name, sql in steps:
        both = both.withColumn(name, F.expr(sql))
    return both.select("a", "b", F.expr(cost).alias("cost"))


EDGE = ("cost", "a", "b")


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (cost, a, b) of the minimum spanning forest, ties by a, then b.

    Every round at least halves the components: each takes its cheapest edge to another one.  Two that take the same edge
    are a root, all others point on; pointers are doubled until they name roots, and edges within a component go."""
    taken: list[DataFrame] = []
    live, seen = scratch.counted(edges.select(*EDGE, F.col("a").alias("u"), F.col("b").alias("v")), "forest-live", n=F.count(F.lit(1)))
    while seen["n"]:
        both = live.unionByName(live.select(*EDGE, F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(*EDGE, "v")).alias("m")).select("u", "m.*")
        pairs = scratch.stored(best.groupBy(*EDGE).agg(F.min("u").alias("u"), F.max("u").alias("w"), F.min_by("v", "u").alias("v")), "forest-pairs")
        taken.append(pairs.select(*EDGE))
        on = pairs.where("u = w").select("u", F.col("v").alias("to")).unionByName(pairs.where("u < w").select(F.explode(F.array("u", "w")).alias("x"), F.col("u").alias("to")).withColumnRenamed("x", "u"))
        pointers, moved = scratch.stored(on, "forest-pointers"), {"n": 1}
        while moved["n"]:
            ahead = pointers.select(F.col("u").alias("to"), F.col("to").alias("next"))
            last = pointers
            pointers, moved = scratch.counted(last.join(ahead, "to").select("u", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "forest-pointers", n=F.count_if("moved"))
            pointers = scratch.renamed(pointers, pointers.select("u", "to"))
            scratch.drop(last)
        relabelled = live
        for end in ("u", "v"):
            relabelled = relabelled.join(pointers.select(F.col("u").alias(end), F.col("to").alias(f"_{end}")), end)
        apart = relabelled.where("_u != _v").select(*EDGE, F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
        fewer = apart.groupBy("u", "v").agg(F.min(F.struct(*EDGE)).alias("m")).select("m.*", "u", "v")
        last = live
        live, seen = scratch.counted(fewer, "forest-live", n=F.count(F.lit(1)))
        scratch.drop(last, pointers)
    out = edges.select(*EDGE).where("false")
    for t in taken:
        out = out.unionByName(t)
    return out


def cheapest(edges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """The first ``n`` edges (cost, a, b) in order: they are sorted into ranges, and only the range in which the n-th
    lies is numbered."""
    ranged = scratch.stored(edges.repartitionByRange(*[F.col(c) for c in EDGE]).withColumn("range", F.spark_partition_id()), "forest-ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range")) - F.col("size"))  # one row per range
    known = ranged.join(sizes, "range")
    within = known.where(f"before < {n} AND before + size > {n}").withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(*EDGE)))
    return known.where(f"before + size <= {n}").select(*EDGE).unionByName(within.where(F.col("before") + F.col("at") <= n).select(*EDGE))


def replayed(edges: np.ndarray, ids: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The point of one cluster by its merges in order: ``edges`` (a, b), sorted; of its vertices, their ids, quadrics and
    positions."""
    at = {int(v): k for k, v in enumerate(ids)}
    parent, q, p = list(range(len(ids))), q.copy(), p.copy()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for u, v in edges:
        x, y = sorted((root(at[int(u)]), root(at[int(v)])), key=lambda k: ids[k])
        q[x] += q[y]
        p[x] = best_points(q[x : x + 1], p[x : x + 1], p[y : y + 1])[0]
        parent[y] = x
    return p[root(0)]


def cluster_points(own: DataFrame, merged: DataFrame) -> DataFrame:
    """``own``: to, vid, position, color and quadric of each vertex; ``merged``: the edges that were merged, with ``to``.  Per
    cluster: its point, color and number of vertices."""
    quadric = [f"q{k}" for k in range(10)]
    sums = own.groupBy("to").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in quadric], *[F.avg(c).alias(c) for c in ("cr", "cg", "cb")], *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    for name, sql in _cost_sql()[0]:
        sums = sums.withColumn(name, F.expr(sql))
    plain = F.expr("n <= 2 OR (abs(det) >= 1e-12 AND " + " AND ".join(f"abs(p{c}) < double('infinity')" for c in "xyz") + ")")
    point = lambda c: F.when((F.col("n") > 1) & (F.abs(F.col(f"p{c}")) < float("inf")), F.col(f"p{c}")).otherwise(F.col(f"m{c}")).alias(c)
    columns = ["to", "n", "cr", "cg", "cb", "x", "y", "z"]
    done = sums.where(plain).select("to", "n", "cr", "cg", "cb", *map(point, "xyz"))
    flat = sums.where(~plain).select("to", "n", "cr", "cg", "cb")
    left, right = (t.join(flat.select("to"), "to", "left_semi").select(*[F.col(c).alias(c) for c in own_columns]) for t, own_columns in ((merged, ("to", *EDGE)), (own, ("to", "vid", *"xyz", *quadric))))

    def replay(key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vid")
        p = replayed(e.sort_values(list(EDGE))[["a", "b"]].to_numpy(), v["vid"].to_numpy(), v[quadric].to_numpy(), v[list("xyz")].to_numpy())
        return pd.DataFrame({"to": [key[0]], **{c: [x] for c, x in zip("xyz", p)}})

    points = left.groupBy("to").cogroup(right.groupBy("to")).applyInPandas(replay, "to bigint, x double, y double, z double")
    return done.select(columns).unionByName(flat.join(points, "to").select(columns))


def quadric_decimate(mesh: Mesh, ratio: float) -> Mesh:
    """Merge along the cheapest edges down to the wanted number of vertices; a cluster keeps its least id.  Costs are
    compared to twelve digits, as sums differ in the last ones from run to run; then the ids decide."""
    n = mesh.vertices.count()
    target = target_vertices(n, ratio)
    if target >= n or mesh.faces.count() < 2:
        return mesh
    with Scratch(mesh.vertices.sparkSession) as scratch:
        quadrics = scratch.stored(vertex_quadrics(mesh), "quadrics")
        edges = scratch.stored(edge_costs(mesh, quadrics).withColumn("cost", F.round("cost", 12)), "costs")
        chosen = scratch.stored(cheapest(spanning_forest(edges, scratch), n - target, scratch), "merges")
        parts = connected_components(chosen, store=scratch.stored)
        new = mesh.vertices.select("vid").join(parts, F.col("vid") == F.col("id"), "left").select("vid", F.coalesce("component", "vid").alias("to"))
        new = stored(new, "merged")
        own = mesh.vertices.select("vid", *"xyz", "cr", "cg", "cb").join(quadrics, "vid").join(new, "vid")
        merged = chosen.join(new.select(F.col("vid").alias("a"), "to"), "a")
        points = stored(cluster_points(own, merged).withColumnRenamed("to", "vid"), "merged-points")
    return _rebuilt(points.select("vid", *"xyz", "cr", "cg", "cb"), remapped(mesh.faces, new))


def decimate(mesh: Mesh, ratio: float, method: str = "quadric") -> Mesh:
    if ratio >= 0.999:
        return mesh
    return quadric_decimate(mesh, ratio) if method == "quadric" else cluster_decimate(mesh, ratio)
