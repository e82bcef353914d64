"""Quadric decimation against one list of merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engine import small_mesh
from voxelmill.operators import decimate, surface
from voxelmill.plans import registry
from voxelmill.tables import Scratch


def plain_forest(edges, n=10**9):
    parent, out = {}, []

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for cost, a, b in sorted(edges):
        if len(out) == n:
            break
        x, y = sorted((root(a), root(b)))
        if x != y:
            parent[y] = x
            out.append((cost, a, b))
    return out, {v: root(v) for v in parent}


def random_edges(seed, n=300, m=900, levels=7):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    return [(float(rng.integers(0, levels)), a, b) for a, b in sorted(pairs)]


@pytest.mark.parametrize("seed, levels", [(1, 7), (2, 1), (3, 10**6)])
def test_forest_and_its_cheapest_edges(spark, seed, levels):
    edges = random_edges(seed, levels=levels)
    df = spark.createDataFrame(edges, "cost double, a bigint, b bigint")
    forest, _ = plain_forest(edges)
    with Scratch(spark) as scratch:
        found = decimate.spanning_forest(df, scratch)
        assert sorted(map(tuple, found.collect())) == sorted(forest)
        for n in (0, 1, 57, len(forest) - 1, len(forest), len(forest) + 5):
            assert sorted(map(tuple, decimate.cheapest(found, n, scratch).collect())) == sorted(forest)[:n]


def test_long_chain_and_no_edges(spark):
    chain = [(float(i), i, i + 1) for i in range(200)]
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(chain, "cost double, a bigint, b bigint")
        assert sorted(map(tuple, decimate.spanning_forest(df, scratch).collect())) == chain
        assert decimate.spanning_forest(df.where("false"), scratch).isEmpty()


def plain_decimation(vertices, faces, edges, ratio):
    """Positions of clusters by their least ids, one merge after another."""
    n = len(vertices)
    quadrics = {v: np.zeros(10) for v in vertices}
    for face in faces:
        a, b, c = (np.array(vertices[v]) for v in face)
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        normal = normal / size if size > 0 else np.array([0.0, 0.0, 1.0])
        plane = np.append(normal, -normal @ a)
        for v in face:
            quadrics[v] += [plane[i] * plane[j] for i, j in decimate.ENTRIES]
    where, root = {v: np.array(p) for v, p in vertices.items()}, {v: v for v in vertices}
    chosen, _ = plain_forest(edges, n - decimate.target_vertices(n, ratio))
    for _, a, b in chosen:
        x, y = sorted((root[a], root[b]))
        quadrics[x] = quadrics[x] + quadrics[y]
        where[x] = decimate.best_points(quadrics[x][None], where[x][None], where[y][None])[0]
        root = {v: x if r == y else r for v, r in root.items()}
    return {r: where[r] for r in set(root.values())}, root


@pytest.mark.parametrize("flat", [False, True])
def test_clusters_against_one_list_of_merges(spark, flat):
    """A bent sheet, and a plane one with a bump: there most clusters have no single best point."""
    side = 12
    bump = lambda i, j: 0.4 * ((i - 6) ** 2 + (j - 6) ** 2 < 6) if flat else 0.05 * (i * i + 0.7 * j * j + 0.3 * i * j * j)
    points = [(float(i) + 0.1 * ((i * j) % 3), float(j), float(bump(i, j))) for i in range(side) for j in range(side)]
    faces = [t for i in range(side - 1) for j in range(side - 1) for o in [i * side + j] for t in ((o, o + side, o + 1), (o + 1, o + side, o + side + 1))]
    m = small_mesh(spark, points, faces)
    rows = decimate.edge_costs(m, decimate.vertex_quadrics(m)).withColumn("cost", F.round("cost", 12)).collect()
    want, root = plain_decimation(dict(enumerate(points)), faces, [(r["cost"], r["a"], r["b"]) for r in rows], 0.4)
    with Scratch(spark) as scratch:
        edges = scratch.stored(spark.createDataFrame([(r["cost"], r["a"], r["b"]) for r in rows], "cost double, a bigint, b bigint"), "edges")
        chosen = decimate.cheapest(decimate.spanning_forest(edges, scratch), len(points) - decimate.target_vertices(len(points), 0.4), scratch)
        to = spark.createDataFrame(list(root.items()), "vid bigint, to bigint")
        own = m.vertices.join(decimate.vertex_quadrics(m), "vid").join(to, "vid")
        got = {r["to"]: (r["x"], r["y"], r["z"]) for r in decimate.cluster_points(own, chosen.join(to.withColumnRenamed("vid", "a"), "a")).collect()}
    assert got.keys() == want.keys()
    assert max(np.abs(np.array(got[k]) - want[k]).max() for k in want) < 1e-5
    out = decimate.quadric_decimate(m, 0.4)
    assert out.vertices.count() <= decimate.target_vertices(len(points), 0.4) and not out.faces.isEmpty()
    assert np.allclose(sorted(tuple(r) for r in out.vertices.select("x", "y", "z").collect()), sorted(tuple(np.float32(want[k])) for k in want if any(root[v] == k for f in faces if len({root[x] for x in f}) == 3 for v in f)), atol=1e-4)


def test_decimated_surface_of_the_tables(spark, sf_dir):
    m = registry.surface_of(spark, sf_dir)[0]
    out = decimate.quadric_decimate(m, 0.5)
    assert isinstance(out, surface.Mesh) and out.vertices.count() <= decimate.target_vertices(m.vertices.count(), 0.5)
    assert "toPandas" not in open(decimate.__file__).read()
