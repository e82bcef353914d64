"""A field's histogram that follows a stream of Gaussians."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_engine import ONE, SIGMA, gaussians
from voxelmill.operators import bounds, density
from voxelmill.streaming import growing

AXES = {c: k for k, c in enumerate(("gid", "x", "y", "z", "s0", "s1", "s2"))}


def moved(gid, opacity=0.8, **changes):
    row = list(ONE)
    row[0], row[16] = gid, opacity
    for c, v in changes.items():
        row[AXES[c]] = v
    return tuple(row)


def rows_of(histogram):
    return sorted((r["bin"], r["exponent"], r["n"], round(r["iso"], 9)) for r in histogram.collect())


@pytest.fixture()
def triggers():
    """Three parts: a wide field, one far away, then sixty in one place, so the range grows by several powers of two."""
    return [
        [moved(0), moved(1, 0.05, x=2.0, s0=0.5)],
        [moved(2, 0.3, x=6.0, y=1.0, s1=2.0)],
        [moved(3 + i, 0.9, x=0.1, s2=0.7) for i in range(60)],
    ]


def test_histogram_equals_the_field_after_every_trigger(spark, tmp_path, triggers):
    every = gaussians(spark, [r for part in triggers for r in part])
    grid = bounds.make_grid(*bounds.robust_bounds(every, SIGMA, 0.01), 20)
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate(triggers):
        frame = gaussians(spark, part).coalesce(1)
        frame.write.mode("append").parquet(str(source))
        growing.follow(spark.readStream.schema(every.schema).parquet(str(source)), grid, SIGMA, out, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()  # a new run goes on with the state
        so_far = density.density_fanout(gaussians(spark, [r for p in triggers[: n + 1] for r in p]), grid, SIGMA)
        assert rows_of(growing.merged(growing.latest(spark, out))) == rows_of(growing.growing_histogram(so_far))
    first, last = (rows_of(growing.merged(growing.latest(spark, out, upto=n))) for n in (0, 2))
    assert last[0][1] >= first[0][1] + 4  # the range has grown, bins have merged


def test_bins_merge_in_pairs(spark):
    rows = [(0, -3, [0] * 62 + [2, 3]), (1, 0, [5, 1] + [0] * 62), (2, -50, [7] + [0] * 63)]
    out = growing.merged(spark.createDataFrame(rows, growing.TILES))
    assert {(r["bin"], r["n"]) for r in out.collect()} == {(7, 5), (0, 12), (1, 1)}
    assert growing.merged(spark.createDataFrame([], growing.TILES)).isEmpty()


def test_exponents():
    for e in range(-20, 20):
        for v in (64 * 2.0**e, np.nextafter(64 * 2.0**e, 0)):
            x = growing.exponent_of(v)
            assert v < 64 * 2.0**x and v >= 32 * 2.0**x
    assert growing.exponent_of(0.0) == growing.LEAST


def test_tiles_at_the_grid_s_edge_and_nulls(spark, tmp_path):
    grid = bounds.Grid((0.0, 0.0, 0.0), (10.0, 8.0, 2.0), 1.0, (11, 9, 3))
    sizes = [len(growing.tile_points(t, grid)) for t in range(4)]
    assert sum(sizes) == 11 * 9 * 3
    rows = [moved(0, x=9.5, y=8.0), moved(1, x=None), moved(2, x=500.0)]
    g = gaussians(spark, rows).withColumn("tile_id", F.lit("extra"))
    g.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = growing.run_files(spark, str(tmp_path / "in"), g.schema, grid, SIGMA, str(tmp_path / "out"), str(tmp_path / "state"))
    want = growing.growing_histogram(density.density_fanout(gaussians(spark, rows[:1]), grid, SIGMA))
    assert rows_of(got) == rows_of(want) and not (tmp_path / "state").exists()


def test_densities_do_not_depend_on_chunks():
    rng = np.random.default_rng(3)
    n = growing.CHUNK + 7
    rows = pd.DataFrame({c: rng.normal(size=n) for c in ("x", "y", "z", *(f"r{i}" for i in range(9)))} | {c: rng.uniform(0.5, 2, n) for c in ("s0", "s1", "s2", "opacity")})
    points = rng.normal(size=(20, 3))
    want = np.zeros(20)
    for g in rows.itertuples():
        turn = np.array([getattr(g, f"r{i}") for i in range(9)]).reshape(3, 3)
        for p in range(20):
            u = turn.T @ (points[p] - [g.x, g.y, g.z]) / [g.s0, g.s1, g.s2]
            want[p] += g.opacity * np.exp(-0.5 * u @ u) if u @ u <= SIGMA**2 else 0
    assert np.allclose(growing.densities(points, rows, SIGMA), want)
