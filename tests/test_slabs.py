"""Repairs slab by slab against the whole field."""

import pytest
from pyspark.sql import functions as F

from voxelmill.operators import repair, surface
from voxelmill.operators.bounds import Grid
from voxelmill.streaming import slabs


@pytest.fixture(scope="module")
def cave(spark):
    """A field on 11 x 12 x 40 points with noise, and caves that reach over several layers, some of them open."""
    grid = Grid((0.0, 0.0, 0.0), (10.0, 11.0, 39.0), 1.0, (11, 12, 40))
    rows = spark.range(grid.voxels).select(F.col("id").alias("vid"), F.expr("CAST(id % 11 AS INT) AS i"), F.expr("CAST(id DIV 11 % 12 AS INT) AS j"), F.expr("CAST(id DIV 132 AS INT) AS k"))
    solid = F.expr("i BETWEEN 2 AND 8 AND j BETWEEN 2 AND 9 AND k BETWEEN 2 AND 37")
    cavity = F.expr("(i = 5 AND j = 5 AND k BETWEEN 4 AND 30) OR (i = 3 AND j = 7 AND k BETWEEN 6 AND 9) OR (i = 7 AND j = 7 AND k >= 20) OR (k = 16 AND j = 5 AND i BETWEEN 3 AND 7) OR (i = 4 AND j = 4 AND k = 8)")
    noise = F.pmod(F.xxhash64("vid"), F.lit(17)) == 0
    on = (solid & ~cavity) != (noise & F.expr("k > 31 OR k < 4"))
    return grid, rows.withColumn("density", F.when(on, 1.0).otherwise(0.125).cast("float")).where("density > 0.5 OR vid % 3 = 0").cache()


def filled(field, grid, depth, schema=slabs.VOXELS):
    return slabs.Slabs(field.sparkSession, grid, depth, schema).fill(lambda a, b: field.where(F.col("k").between(a, b - 1)))


def rows_of(df, digits=4):
    return sorted((r["vid"], round(r["density"], digits)) for r in df.collect())


EVERYTHING = {"denoise_iterations": 1, "fill_voids": True, "band": 5}


@pytest.mark.parametrize(("depth", "steps"), [(8, EVERYTHING), (13, {"denoise_iterations": 2, "fill_voids": True}), (24, {"band": 3}), (64, EVERYTHING)])
def test_equal_to_the_whole(spark, cave, depth, steps):
    grid, voxels = cave
    want = repair.process_field(voxels, grid, 0.5, **steps)
    got, iso, changes, points = slabs.repair_by_slabs(filled(voxels, grid, depth), 0.5, depth, **steps)
    assert (iso, changes, points) == (want.iso, want.denoised, want.filled)
    assert rows_of(got.whole()) == rows_of(want.voxels)
    if "fill_voids" in steps:
        assert points > 0


def test_nothing_to_repair_and_absent_layers(spark, cave):
    grid, voxels = cave
    field = filled(voxels, grid, 8)
    assert slabs.repair_by_slabs(field, 0.5, 8) == (field, 0.5, 0, 0)
    none = filled(voxels.where("false"), grid, 8)
    assert none.whole().isEmpty() and slabs.repair_by_slabs(none, 0.5, 8, denoise_iterations=1)[0].whole().isEmpty()
    thin = filled(voxels.where("k BETWEEN 17 AND 19"), grid, 8)
    assert rows_of(slabs.repair_by_slabs(thin, 0.5, 8, fill_voids=True)[0].whole()) == rows_of(repair.process_field(voxels.where("k BETWEEN 17 AND 19"), grid, 0.5, fill_voids=True).voxels)


def test_a_step_reads_its_slabs_only(spark, cave):
    grid, voxels = cave
    field = filled(voxels, grid, 8)
    files = {f.split("/slab=")[1].split("/")[0] for f in field.layers(15, 25).inputFiles()}
    assert files and field.layers(15, 25).count() == voxels.where("k BETWEEN 15 AND 24").count()
    plan = field.layers(15, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slab" in plan and "slab#" in plan.split("PartitionFilters")[1][:120]


def test_crossings_and_a_threshold_of_zero(spark, cave):
    grid, voxels = cave
    field, iso, *_ = slabs.repair_by_slabs(filled(voxels, grid, 8), 0.5, 8, band=3)
    assert iso == 0
    whole = surface.crossings(surface.cube_values(field.whole(), grid, 0.0), grid, 0.0)
    key = lambda df: sorted((r["tet_id"], r["slot"], r["ia"], r["ib"]) for r in df.collect())
    assert key(slabs.slab_crossings(field, 0.0)) == key(whole)
