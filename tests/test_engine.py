"""Invariants and brute force for the splat operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import bounds, decimate, density, graph, holes, mesh, repair, surface
from voxelmill.params import Params, format_bytes, suggest, with_preset
from voxelmill.session import SplatSession
from voxelmill.sources.samples import shells
from voxelmill.streaming import density_stream, slabs

SIGMA = 3.0
ONE = (0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.8, 1.0, 0.2, 0.1)


def gaussians(spark, rows):
    return spark.createDataFrame(rows, "gid bigint, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "s0", "s1", "s2", *(f"r{i}" for i in range(9)), "opacity", "cr", "cg", "cb")))


def field(spark, values, dims):
    """Sparse field of {(i, j, k): density}."""
    grid = bounds.Grid((0.0, 0.0, 0.0), tuple(float(d - 1) for d in dims), 1.0, dims)
    rows = [((k * dims[1] + j) * dims[0] + i, i, j, k, float(v)) for (i, j, k), v in values.items()]
    return grid, spark.createDataFrame(rows, "vid bigint, i int, j int, k int, density float")


@pytest.fixture(scope="module")
def sphere(spark):
    g = gaussians(spark, [ONE])
    grid = bounds.make_grid(*bounds.robust_bounds(g, SIGMA, 0.01), 18)
    voxels = density.density_fanout(g, grid, SIGMA).cache()
    return g, grid, voxels, surface.extract_mesh(voxels, g, grid, 0.2, SIGMA)


def test_single_gaussian_surface_is_closed_round_and_colored(sphere):
    g, grid, voxels, m = sphere
    assert mesh.topology(m).first().asDict() == {"boundary_edges": 0, "non_manifold_edges": 0, "degenerate_faces": 0, "components": 1}
    r = m.vertices.select(F.sqrt(F.expr("x * x + y * y + z * z")).alias("r"), F.expr("nx * x + ny * y + nz * z").alias("out"), "cr").toPandas()
    assert abs(r["r"] - np.sqrt(-2 * np.log(0.2 / 0.8))).max() < 0.1
    assert (r["out"] > 0).all() and np.allclose(r["cr"], 1.0)


def test_density_by_tiles_and_brute_force(spark, sphere):
    g, grid, voxels, _ = sphere
    two = gaussians(spark, [ONE, (1, 2.5, 0.3, 0.1, 0.4, 0.9, 0.2, *ONE[7:])])
    a = {r["vid"]: r["density"] for r in density.density_fanout(two, grid, SIGMA).collect()}
    b = {r["vid"]: r["density"] for r in density.density_tilejoin(two, grid, SIGMA).collect()}
    assert a.keys() == b.keys() and all(abs(a[v] - b[v]) < 1e-6 for v in a)
    assert slabs.validate_density(voxels, g, grid, SIGMA).where("NOT ok").isEmpty()


def test_slabs_give_the_whole_surface(sphere):
    _, grid, voxels, _ = sphere
    whole = surface.crossings(surface.cube_values(voxels, grid, 0.2), grid, 0.2)
    own = slabs.Slabs(voxels.sparkSession, grid, 8, slabs.VOXELS).fill(lambda a, b: voxels.where(F.col("k").between(a, b - 1)))
    parts = slabs.slab_crossings(own, 0.2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_quantile_rank_rule(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 5000):
        x = np.round(r.standard_normal(n), 2)
        df = spark.createDataFrame([(float(v),) for v in x], "v double")
        for q in (0.0, 0.01, 0.5, 0.95, 1.0):
            assert bounds.quantiles(df, "v", [q]) == [np.sort(x)[int(np.floor((n - 1) * q + 0.5))]]
    assert bounds.quantiles(spark.createDataFrame([(float("nan"),)], "v double"), "v", [0.5]) == []


def test_void_is_filled_and_distance_surface_is_closed(spark):
    shell = {(i, j, k): 1.0 for i in range(1, 6) for j in range(1, 6) for k in range(1, 6) if (i, j, k) != (3, 3, 3)}
    grid, voxels = field(spark, shell, (7, 7, 7))
    out = repair.process_field(voxels, grid, 0.5, fill_voids=True)
    assert out.filled == 1 and out.voxels.where("i = 3 AND j = 3 AND k = 3").first()["density"] > 0.5
    assert repair.process_field(field(spark, {}, (4, 4, 4))[1], field(spark, {}, (4, 4, 4))[0], 0.5, fill_voids=True).filled == 0
    block = {(i, j, k): 1.0 for i in (2, 3, 4) for j in (2, 3, 4) for k in (2, 3, 4)}
    grid, voxels = field(spark, block, (7, 7, 7))
    sdf = repair.process_field(voxels, grid, 0.5, band=3)
    at = {(r["i"], r["j"], r["k"]): r["density"] for r in sdf.voxels.collect()}
    assert sdf.iso == 0 and len(at) == 343 and at[3, 3, 3] > 0 > at[0, 0, 0]
    assert mesh.topology(surface.extract_mesh(sdf.voxels, None, grid, 0.0, SIGMA)).first()["boundary_edges"] == 0


def test_denoise_against_brute_force(spark):
    r = np.random.default_rng(3)
    occ = r.random((6, 7, 8)) < 0.5
    grid, voxels = field(spark, {tuple(map(int, p)): 1.0 for p in np.argwhere(occ)}, occ.shape)
    got = {tuple(x) for x in repair.denoise(voxels.select("i", "j", "k"), grid)[0].collect()}
    want = occ.copy()
    for i, j, k in np.ndindex(*occ.shape):
        if 0 < i < 5 and 0 < j < 6 and 0 < k < 7:
            n = sum(occ[i + a, j + b, k + c] for a, b, c in repair.STEPS)
            want[i, j, k] = n > 1 if occ[i, j, k] else n >= 5
    assert got == {tuple(map(int, p)) for p in np.argwhere(want)}


def small_mesh(spark, points, faces):
    rows = [(i, *map(float, p), 0.0, 0.0, 1.0, 0.5, 0.5, 0.5) for i, p in enumerate(points)]
    v = spark.createDataFrame(rows, "vid bigint, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "nx", "ny", "nz", "cr", "cg", "cb")))
    return surface.Mesh(v, spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "fid bigint, a bigint, b bigint, c bigint"))


def test_small_meshes(spark):
    two = small_mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 0, 0), (6, 0, 0), (5, 1, 0)], [(0, 1, 2), (3, 4, 5)])
    kept = mesh.cleanup(two, keep_largest=True, min_faces=1, smoothing=0)
    assert [tuple(r) for r in kept.faces.collect()] == [(0, 0, 1, 2)] and kept.vertices.count() == 3
    assert mesh.cleanup(two, keep_largest=True, min_faces=2, smoothing=0).faces.isEmpty()
    tetra = small_mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 3), (1, 2, 3), (2, 0, 3)])
    capped, n = holes.fill_holes(tetra, 3)
    t = mesh.topology(capped).first()
    assert (n, capped.faces.count(), t["boundary_edges"], t["components"]) == (1, 6, 0, 1)
    assert holes.fill_holes(tetra, 2)[1] == 0


def test_hole_loops_of_a_punctured_plane(spark):
    """Quads left out of a plane: alone, side by side, touching at corners; and the plane's own rim."""
    out = {(2, 2), (5, 5), (6, 6), (8, 2), (9, 2), (2, 8), (3, 9), (4, 8)}
    corner = lambda x, y: y * 13 + x
    quads = [(x, y) for y in range(12) for x in range(12) if (x, y) not in out]
    faces = [f for x, y in quads for f in ((corner(x, y), corner(x + 1, y), corner(x + 1, y + 1)), (corner(x, y), corner(x + 1, y + 1), corner(x, y + 1)))]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "fid bigint, a bigint, b bigint, c bigint")
    loops: dict = {}
    for r in holes.hole_loops(df, 64).collect():
        loops.setdefault((r["loop"], r["second"]), []).append((r["pos"], r["vid"]))
    found = [[v for _, v in sorted(loop)] for loop in loops.values()]
    sides = {(f[i], f[(i + 1) % 3]) for f in faces for i in range(3)}
    rim = {(u, v) for u, v in sides if (v, u) not in sides}
    assert sorted(map(len, found)) == [4, 4, 4, 4, 4, 4, 6, 48] and set(rim) == {(p[i], p[(i + 1) % len(p)]) for p in found for i in range(len(p))}
    walked = [(p[i], p[(i + 1) % len(p)]) for p in found for i in range(len(p))]
    assert set(walked) <= rim and len(walked) == len(set(walked)) and all(p[0] == min(p) or p[0] in {corner(6, 6), corner(3, 9), corner(4, 9)} for p in found)
    assert {r["loop"] for r in holes.hole_loops(df, 4).collect()} == {p[0] for p in found if len(p) == 4}
    assert holes.hole_loops(df.where("false"), 8).isEmpty()


def test_star_of_many_leaves(spark):
    """Links of a hub are joined by all tasks: it is a table of its own."""
    star = spark.range(1, 200_001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    got = graph.connected_components(star)
    assert got.count() == 200_000 and got.where("component != 0").isEmpty()


def test_ranks_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(bounds, "BRACKET", 50)
    r = np.random.default_rng(8)
    v = np.concatenate([r.normal(size=9000), np.full(4000, 0.25), r.integers(0, 5, 3000)])
    df = spark.createDataFrame([(float(x), float(-x)) for x in v], "v double, w double")
    ranks = [0, 1, 160, 8000, 12_000, 15_998, 15_999]
    got = bounds.ranked_values(df, {"v": ranks, "w": ranks[:2]}, len(v))
    assert got == {"v": np.sort(v)[ranks].tolist(), "w": np.sort(-v)[ranks[:2]].tolist()}


def test_decimation_is_repeatable_and_smaller(sphere):
    m = sphere[3]
    n = m.vertices.count()
    runs = [sorted(map(tuple, decimate.quadric_decimate(m, 0.5).faces.collect())) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0]
    assert decimate.cluster_decimate(m, 0.3).vertices.count() < n
    assert decimate.decimate(m, 1.0) is m


def test_components_against_brute_force(spark):
    r = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in r.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {x["id"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    low = {v: v for e in edges for v in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {v: c for v, c in low.items() if v != c}


def test_session_on_the_sample(spark):
    raw = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(shells())], "gid bigint, " + ", ".join(f"{c} double" for c in shells()[0]))
    s = SplatSession(spark)
    assert s.load_raw(raw)["retained_count"] == 540
    out = s.start(Params(resolution=18, smoothing=0, min_component_faces=1, keep_largest=False))
    q = out.quality.first()
    assert (q["boundary_edges"], q["non_manifold_edges"], q["degenerate_faces"]) == (0, 0, 0) and out.mesh.faces.count() > 0
    assert s.extract(Params(smoothing=1), iso=out.iso * 1.5).iso == out.iso * 1.5
    assert s.preview(100).count() == 100
    with pytest.raises(RuntimeError):
        SplatSession(spark).start(Params())


def test_params():
    assert with_preset("detailed").resolution == 160 and suggest(600_000, 0).resolution == 64 and suggest(0, 300 * 2**20).slab_mode
    assert [format_bytes(n) for n in (10, 2048, 20 * 2**20, -1)] == ["10 B", "2.0 KiB", "20 MiB", "—"]
    assert [format_bytes(n) for n in (0, 1023, 1024, 3 * 2**40)] == ["0 B", "1023 B", "1.0 KiB", "3072 GiB"]


def test_density_of_a_stream(spark, tmp_path, sphere):
    g, grid, voxels, _ = sphere
    for i in range(2):
        g.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = density_stream.density_stream(stream, grid, SIGMA).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    both = spark.table("grown").join(voxels.select("vid", F.col("density").alias("once")), "vid")
    assert both.count() == voxels.count() and both.where(F.abs(F.col("density") - 2 * F.col("once")) > 1e-5).isEmpty()


def brute_edge_costs(vertices, faces):
    """{(a, b): (cost, determinant)} from planes, one edge at a time."""
    quadrics = {v: np.zeros((4, 4)) for v in vertices}
    for face in faces:
        a, b, c = (np.array(vertices[v]) for v in face)
        n = np.cross(b - a, c - a)
        n = n / np.linalg.norm(n) if np.linalg.norm(n) > 0 else np.array([0.0, 0.0, 1.0])
        plane = np.append(n, -n @ a)
        for v in face:
            quadrics[v] += np.outer(plane, plane)
    out = {}
    for a, b in {(min(e), max(e)) for f in faces for e in zip(f, (*f[1:], f[0]), strict=True)}:
        q, det = quadrics[a] + quadrics[b], np.linalg.det((quadrics[a] + quadrics[b])[:3, :3])
        p = np.linalg.solve(q[:3, :3], -q[:3, 3]) if abs(det) >= 1e-12 else (np.array(vertices[a]) + vertices[b]) / 2
        p = np.append(p, 1)
        out[a, b] = p @ q @ p, det
    return out


def test_edge_costs_of_all_edges(spark, sphere, sf_dir):
    from voxelmill.plans import registry

    def compare(m, rows):
        want = brute_edge_costs({r["vid"]: (r["x"], r["y"], r["z"]) for r in m.vertices.collect()}, [(r["a"], r["b"], r["c"]) for r in m.faces.collect()])
        assert len(rows) == len(want) > 10 and {(r["a"], r["b"]) for r in rows} == want.keys()
        clear = [r for r in rows if not 1e-13 < abs(want[r["a"], r["b"]][1]) < 1e-9]  # beside the bound rounding decides
        assert len(clear) > 0.9 * len(rows) and max(abs(r["cost"] - want[r["a"], r["b"]][0]) for r in clear) < 1e-5

    m = sphere[3]
    compare(m, decimate.edge_costs(m, decimate.vertex_quadrics(m)).collect())
    rows = registry.QUERIES["quadric_edge_costs"](spark, sf_dir).collect()
    assert [r["cost"] for r in rows] == sorted(r["cost"] for r in rows)
    compare(registry.surface_of(spark, sf_dir)[0], rows)


def test_session_by_slabs_with_progress(spark):
    """Slab mode gives the whole's mesh, stages come in order, and dispose leaves nothing to convert."""
    from voxelmill.sources.adapter import raw_from_embeddings

    raw, told, counts = raw_from_embeddings(spark, "/root/testdata/sf0.001/embeddings.parquet"), [], []
    for slab_mode in (False, True):
        s = SplatSession(spark, lambda stage, share, whole: told.append((stage, whole)))
        s.load_raw(raw)
        out = s.start(Params(resolution=20, min_component_faces=1, smoothing=0, slab_mode=slab_mode, slab_depth=8))
        counts.append((out.mesh.vertices.count(), out.mesh.faces.count(), *out.quality.first(), round(out.iso, 6)))
        assert out.metadata()["vertices"] == out.mesh.vertices.count() and out.metadata()["raw_triangles"] >= out.metadata()["triangles"] and out.metadata()["dims"] == out.grid.dims
        s.dispose()
        with pytest.raises(RuntimeError):
            s.start(Params())
    assert counts[0] == counts[1] and counts[0][0] > 10
    first = told[: next(i for i, t in enumerate(told) if t[0] == "ready") + 1]
    assert list(dict.fromkeys(x for x, _ in first)) == ["parsing", "activating", "indexing", "voxelizing", "extracting", "cleaning", "ready"]
    assert [w for _, w in first] == sorted(w for _, w in first) and first[-1] == told[-1] == ("ready", 1.0)
    assert len(first) > 7  # tasks are told of while a stage runs


def test_diagnostics_of_a_scene(spark):
    from voxelmill.operators import activate, diagnostics
    from voxelmill.sources.adapter import raw_from_embeddings

    every = activate.activate(raw_from_embeddings(spark, "/root/testdata/sf0.001/embeddings.parquet"))
    rows = [diagnostics.inspection(every, mode, resolution=14, smoothing=0).first() for mode in ("all", "crop", "anisotropic")]
    assert rows[0]["case_retained"] == rows[0]["opacity_retained"] > rows[1]["case_retained"] and rows[2]["case_retained"] >= 0.05 * rows[0]["opacity_retained"]
    assert all(r["triangles"] <= r["raw_triangles"] and r["ratio_p95"] <= r["ratio_p99"] <= r["ratio_max"] for r in rows)
    with pytest.raises(ValueError, match="unknown mode"):
        activate.diagnostic_subset(every, "other")
    with pytest.raises(ValueError, match="no Gaussians"):
        diagnostics.inspection(every, threshold=2.0)
