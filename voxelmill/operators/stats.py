"""Statistics of a field, its histogram, and the automatic threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounds import EPSILON, Grid

BINS = 32


def density_stats(voxels: DataFrame, grid: Grid) -> DataFrame:
    """One row: min_density and max_density over all points of the grid (absent ones are 0, and the maximum is 0 at
    least), non_zero."""
    d = F.col("density").cast("double")
    out = voxels.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.count_if(d > 0).alias("non_zero"), F.count("*").alias("n"))
    low = F.when(F.col("n") < grid.voxels, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    return out.select(low.alias("min_density"), F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0)).alias("max_density"), "non_zero")


def density_histogram(voxels: DataFrame, stats: DataFrame) -> DataFrame:
    """bin and n of the positive values, of 32 bins that the range spreads over 31 widths; empty bins are rows too."""
    d = F.col("density").cast("double")
    scaled = (d - F.col("min_density")) / F.greatest(F.lit(EPSILON), F.col("max_density") - F.col("min_density")) * (BINS - 1)
    found = voxels.where(d > 0).crossJoin(F.broadcast(stats)).select(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(scaled))).cast("int").alias("bin"))  # stats: one row
    every = voxels.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(found.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def automatic_iso(stats: DataFrame, histogram: DataFrame) -> DataFrame:
    """One row, iso: the middle of the first bin that brings the count to 55 % of the positive values; 0 for an empty
    field, a fifth of the maximum if no bin does."""
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 32 rows
    sums = histogram.select("bin", F.sum("n").over(order).alias("upto")).crossJoin(F.broadcast(stats))
    hit = sums.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("non_zero") * F.lit(0.55)))).agg(F.min("bin").alias("bin"))
    width = F.greatest(F.lit(EPSILON), F.col("max_density") - F.col("min_density"))
    iso = F.when(F.col("max_density") <= 0, 0.0).when(F.col("bin").isNull(), F.col("max_density") * 0.2).otherwise(F.col("min_density") + width * ((F.col("bin") + 0.5) / BINS))
    return stats.crossJoin(F.broadcast(hit)).select(iso.alias("iso"))


def slab_stats(voxels: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Statistics of slabs of ``depth`` layers; the slabs' fold is the whole field's."""
    depth = max(8, min(64, depth))
    d = F.col("density").cast("double")
    slabs = voxels.withColumn("slab", F.floor(F.col("k") / depth).cast("int"))
    return slabs.groupBy("slab").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("non_zero"), F.max(d).alias("max_density"), F.sum(d).alias("total"))


def occupancy_slices(voxels: DataFrame, iso: float) -> DataFrame:
    """Occupied points (density at least iso) of each layer that has some."""
    return voxels.where(F.col("density").cast("double") >= iso).groupBy("k").agg(F.count("*").alias("occupied"))
