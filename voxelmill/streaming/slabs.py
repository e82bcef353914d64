"""Execution slab by slab: bounded work per step, with the result of the whole.

A field's files are parted by slab, so a step reads its own layers and the few beside them that it needs: one for
cubes and for a round of denoising, the band and one more for distances.  Voids are found as components within each
slab, then merged over the faces between slabs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import density, repair, surface
from ..operators.bounds import Grid
from ..operators.graph import connected_components
from ..tables import adopted, new_path, stored, without_leftovers

VOXELS = "vid bigint, i int, j int, k int, density float"
POINTS = "i int, j int, k int"
RUNS = "j int, k int, a int, b int, id bigint, part bigint"


def slab_ranges(grid: Grid, depth: int) -> list[tuple[int, int]]:
    """Layers [a, b) of each slab; a slab has 8 to 64 layers."""
    depth = max(8, min(64, int(depth + 0.5)))
    return [(a, min(grid.dims[2], a + depth)) for a in range(0, grid.dims[2], depth)]


class Slabs:
    """Rows with a layer k in files parted by slab."""

    def __init__(self, spark: SparkSession, grid: Grid, depth: int, schema: str):
        self.spark, self.grid, self.ranges, self.schema = spark, grid, slab_ranges(grid, depth), schema
        self.depth = self.ranges[0][1]
        self.path = new_path(spark, "slabs")
        self.table = adopted(spark.read.schema(f"{schema}, slab int").parquet(self._empty()), self.path)

    def _empty(self) -> str:
        """The path, once there is a table without rows."""
        self.spark.createDataFrame([], f"{self.schema}, slab int").write.partitionBy("slab").parquet(self.path)
        return self.path

    def fill(self, rows: Callable[[int, int], DataFrame]) -> Slabs:
        """Write the slabs one after another; ``rows`` gives those of the layers [a, b)."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        with without_leftovers(self.spark):
            for number, (a, b) in enumerate(self.ranges):
                rows(a, b).select(*names, F.lit(number).alias("slab")).write.mode("append").partitionBy("slab").parquet(self.path)
        return self

    def layers(self, lo: int, hi: int) -> DataFrame:
        """The rows of the layers from ``lo`` to before ``hi``: only the slabs that have them are read."""
        rows = self.spark.read.schema(f"{self.schema}, slab int").parquet(self.path)
        return rows.where(F.col("slab").between(max(0, lo) // self.depth, (hi - 1) // self.depth) & F.col("k").between(lo, hi - 1)).drop("slab")

    def whole(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, slab int").parquet(self.path).drop("slab")


def density_by_slabs(gaussians: DataFrame, grid: Grid, sigma: float, depth: int) -> Slabs:
    """The field of ``density_fanout``, slab after slab: a step meets only the supports that reach its layers, and its
    sums are written before the next one begins."""
    return Slabs(gaussians.sparkSession, grid, depth, VOXELS).fill(lambda a, b: density.density_fanout(gaussians, grid, sigma, layers=(a, b - 1)))


def slab_crossings(field: Slabs, iso: float) -> DataFrame:
    """Crossings of all slabs.  A slab's cubes start in it and need one layer more; no cube is in two slabs, and
    vertices are numbered over all, so no seam needs welding."""
    grid, schema, path = field.grid, None, new_path(field.spark, "crossings")
    with without_leftovers(field.spark):
        for a, b in field.ranges:
            hi = min(b + 1, grid.dims[2])
            cubes = surface.cube_values(field.layers(a, hi), grid, iso, (a, hi)).where(F.col("z").between(a, b - 1))
            rows = surface.crossings(cubes, grid, iso)
            schema = rows.schema
            rows.write.mode("append").parquet(path)
    return adopted(field.spark.read.schema(schema).parquet(path), path)


def denoise_by_slabs(occupied: Slabs, depth: int) -> tuple[Slabs, int]:
    """One round of denoising with a layer from each neighbour, and the number of changes."""
    changes = 0
    seen: list[Observation] = []

    def round_(a: int, b: int) -> DataFrame:
        seen.append(Observation())
        counts = repair.denoised(occupied.layers(a - 1, b + 1), occupied.grid).where(F.col("k").between(a, b - 1))
        return counts.observe(seen[-1], F.count_if((F.col("own") == 1) != F.col("after")).alias("n")).where("after")

    out = Slabs(occupied.spark, occupied.grid, depth, POINTS).fill(round_)
    for s in seen:
        changes += s.get["n"]
    return out, changes


def voids_by_slabs(occupied: Slabs, depth: int) -> DataFrame:
    """The points of ``repair.enclosed_points``: components of runs within each slab, then of these components where
    runs of neighbouring slabs overlap."""
    grid = occupied.grid

    def parts(a: int, b: int) -> DataFrame:
        runs = stored(repair.empty_runs(occupied.layers(a, b), grid, (a, b)), "runs")
        own = connected_components(repair.run_links(runs, runs))
        return runs.join(own, "id", "left").withColumn("part", F.coalesce("component", "id"))

    runs = Slabs(occupied.spark, grid, depth, RUNS).fill(parts)
    every = runs.whole()
    starts = [a for a, _ in runs.ranges[1:]]
    if starts:
        below, above = every.where(F.col("k").isin([a - 1 for a in starts])), every.where(F.col("k").isin(starts))
        links = repair.run_links(below, above)
        for end, side in (("a", below), ("b", above)):
            links = links.join(side.select(F.col("id").alias(end), F.col("part").alias(f"_{end}")), end)
        merged = connected_components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        every = every.join(merged.select(F.col("id").alias("part"), "component"), "part", "left").withColumn("part", F.coalesce("component", "part"))
    every = stored(every.select("j", "k", "a", "b", "part"), "void-parts")
    inside = every.join(every.where(repair.at_border(grid)).select("part").distinct(), "part", "left_anti")
    return inside.select(F.explode(F.sequence("a", "b")).alias("i"), "j", "k")


def repair_by_slabs(field: Slabs, iso: float, depth: int, *, denoise_iterations: int = 0, fill_voids: bool = False, band: float = 0) -> tuple[Slabs, float, int, int]:
    """What ``repair.process_field`` does, slab by slab: the field, its threshold, and the points denoised and filled."""
    if denoise_iterations <= 0 and not fill_voids and band <= 0:
        return field, iso, 0, 0
    grid, spark = field.grid, field.spark
    new = lambda schema: Slabs(spark, grid, depth, schema)
    occupied = new(POINTS).fill(lambda a, b: repair.occupied_points(field.layers(a, b), grid, iso, (a, b)))
    changes = filled = 0
    for _ in range(denoise_iterations):
        occupied, flips = denoise_by_slabs(occupied, depth)
        changes += flips
    if fill_voids:
        voids = new(POINTS).fill(lambda a, b, every=stored(voids_by_slabs(occupied, depth), "voids"): every.where(F.col("k").between(a, b - 1)))
        filled, before = voids.whole().count(), occupied
        occupied = new(POINTS).fill(lambda a, b: before.layers(a, b).unionByName(voids.layers(a, b)))
    if band > 0:
        halo = repair.whole_band(band) + 1
        window = lambda a, b: (max(0, a - halo), min(grid.dims[2], b + halo))
        distances = lambda a, b: repair.signed_distance(occupied.layers(*window(a, b)), grid, band, window(a, b)).where(F.col("k").between(a, b - 1))
        return new(VOXELS).fill(distances), 0.0, changes, filled
    return new(VOXELS).fill(lambda a, b: repair.reclassified(field.layers(a, b), occupied.layers(a, b), grid, iso, (a, b))), iso, changes, filled


def validate_density(voxels: DataFrame, gaussians: DataFrame, grid: Grid, sigma: float, samples: int = 32) -> DataFrame:
    """Points floor((s + 0.5) * N / samples) of the grid, their density, and its value by brute force over all
    Gaussians: vid, density, exact, and ok (within 0.002, or a hundredth)."""
    ids = [int((s + 0.5) * grid.voxels / samples) for s in range(samples)]
    nx, ny = grid.dims[0], grid.dims[1]
    spark = voxels.sparkSession
    points = spark.createDataFrame([(v, v % nx, v // nx % ny, v // (nx * ny)) for v in ids], "vid bigint, i int, j int, k int")
    every = gaussians.crossJoin(F.broadcast(points.drop("vid")))  # a fixed number of points
    exact = density._contributions(every, grid, sigma).groupBy("vid").agg(F.sum("value").alias("exact"))
    out = points.join(voxels.where(F.col("vid").isin(ids)).select("vid", "density"), "vid", "left").join(exact, "vid", "left")
    d, e = F.coalesce(F.col("density").cast("double"), F.lit(0.0)), F.coalesce("exact", F.lit(0.0))
    return out.select("vid", d.alias("density"), e.alias("exact"), ((F.abs(d - e) <= 0.002) | (F.abs(d - e) <= 0.01 * F.abs(e))).alias("ok"))
