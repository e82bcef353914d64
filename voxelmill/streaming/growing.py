"""Histogram and threshold of a field that grows with a stream of Gaussians.

Bins have a width of a power of two, the least at which ``BINS`` of them hold the highest density.  When the range
grows, bins merge in pairs, so the histogram of every tile and of the whole field can follow the stream, and equals
that of the same Gaussians at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gaussian import ACTIVATED
from ..operators.bounds import TILE, Grid
from ..operators.density import tile_candidates
from ..tables import remove

BINS = 64
#: The least exponent of a width; a field without density has it.
LEAST = -60
#: Gaussians that meet the points of a tile at once: 512 points each.
CHUNK = 512
TILES = "tile_id bigint, exponent int, counts array<bigint>"


def exponent_of(highest: float) -> int:
    """The least e at which ``BINS`` bins of width 2^e hold ``highest``."""
    return max(LEAST, int(np.frexp(highest / BINS)[1])) if highest > 0 else LEAST


def tile_points(tile: int, grid: Grid) -> np.ndarray:
    """Positions of the lattice points of a tile, those outside the grid left out."""
    nx, ny, _ = grid.tile_dims
    corner = (tile % nx, tile // nx % ny, tile // (nx * ny))
    axes = [np.arange(t * TILE, min((t + 1) * TILE, n)) * grid.spacing + low for t, n, low in zip(corner, grid.dims, grid.low, strict=True)]
    return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)


def densities(points: np.ndarray, rows: pd.DataFrame, sigma: float) -> np.ndarray:
    """Sums over the Gaussians of ``rows`` at the points."""
    out = np.zeros(len(points))
    for at in range(0, len(rows), CHUNK):
        part = rows.iloc[at : at + CHUNK]
        offset = points[None] - part[["x", "y", "z"]].to_numpy()[:, None]
        turn = part[[f"r{i}" for i in range(9)]].to_numpy().reshape(-1, 3, 3)
        own = np.einsum("gpa,gab->gpb", offset, turn) / part[["s0", "s1", "s2"]].to_numpy()[:, None]
        d2 = np.square(own).sum(axis=2)
        out += np.where(d2 <= sigma * sigma, part["opacity"].to_numpy()[:, None] * np.exp(-0.5 * d2), 0.0).sum(axis=0)
    return out


def _follow(grid: Grid, sigma: float) -> Callable:
    """State of a tile: the sums at its points.  Each trigger that reaches the tile gives its histogram anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        points = tile_points(key[0], grid)
        sums = np.array(state.get[0]) if state.exists else np.zeros(len(points))
        for rows in batches:
            sums = sums + densities(points, rows, sigma)
        state.update((sums.tolist(),))
        values = sums.astype("float32").astype("float64")  # as the field's column
        e = exponent_of(values.max())
        counts = np.bincount((values[values > 0] / 2.0**e).astype("int64"), minlength=BINS)
        yield pd.DataFrame({"tile_id": [key[0]], "exponent": [e], "counts": [counts.tolist()]})

    return step


def tile_histograms(gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """``gaussians``: a streaming DataFrame of activated rows; update mode.  tile_id, exponent and counts of each tile
    that a trigger has reached, over all that has come so far.

    A Gaussian is shuffled once per tile of its support, not once per point.  The state is one row of at most 512 sums per
    tile, so it is bounded by the grid; a tile's Gaussians pass through its task in batches.  ``maxFilesPerTrigger`` or
    its like bounds what one trigger brings to a tile.  Rows with a null among the activated columns are left out."""
    rows = tile_candidates(gaussians.dropna(subset=list(ACTIVATED)), grid, sigma)
    return rows.groupBy("tile_id").applyInPandasWithState(_follow(grid, sigma), TILES, "sums array<double>", "update", "NoTimeout")


def follow(gaussians: DataFrame, grid: Grid, sigma: float, path: str, checkpoint: str):
    """A writer of the stream's histograms to ``path``: a folder per trigger, which a repeated trigger writes again."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return tile_histograms(gaussians, grid, sigma).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)


def latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last histogram of each tile, or that after the trigger ``upto``."""
    rows = spark.read.schema(f"{TILES}, trigger bigint").option("basePath", path).parquet(path)
    if upto is not None:
        rows = rows.where(F.col("trigger") <= upto)
    last = rows.groupBy("tile_id").agg(F.max_by(F.struct("exponent", "counts"), "trigger").alias("h"))
    return last.select("tile_id", "h.exponent", "h.counts")


def _finished(bins: DataFrame) -> DataFrame:
    """bin, exponent, n and the threshold of the whole: the middle of the first bin that brings the count to 55 %."""
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows
    every = Window.partitionBy()
    sums = bins.select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(every).alias("total"))
    hit = F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(0.55))), F.col("bin"))).over(every)
    return sums.select("bin", "exponent", "n", ((hit + 0.5) * F.pow(F.lit(2.0), "exponent")).alias("iso"))


def merged(tiles: DataFrame) -> DataFrame:
    """The field's histogram from its tiles': bin, exponent, n (positive) and iso; no row for an empty field."""
    top = tiles.agg(F.max("exponent").alias("top"))
    bins = tiles.join(F.broadcast(top)).select("top", F.expr("top - exponent").alias("_up"), F.posexplode("counts").alias("_b", "_n")).where("_n > 0")  # top: one row
    bins = bins.groupBy(F.expr("IF(_up > 30, 0, shiftright(_b, _up))").alias("bin"), F.col("top").alias("exponent")).agg(F.sum("_n").alias("n"))
    return _finished(bins)


def growing_histogram(voxels: DataFrame) -> DataFrame:
    """The same rows of a field that is there at once."""
    d = F.col("density").cast("double")
    top = voxels.agg(F.greatest(F.lit(LEAST), F.floor(F.log2(F.max(d) / BINS)) + 1).cast("int").alias("exponent"))
    found = voxels.where(d > 0).join(F.broadcast(top)).select("exponent", F.floor(d / F.pow(F.lit(2.0), "exponent")).cast("int").alias("bin"))  # top: one row
    return _finished(found.groupBy("bin", "exponent").agg(F.count("*").alias("n")))


def run_files(spark: SparkSession, source: str, schema, grid: Grid, sigma: float, path: str, checkpoint: str) -> DataFrame:
    """Follow a folder of activated Gaussians, one file a trigger, to its end; the field's histogram then.  The state goes
    with the run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    try:
        follow(stream, grid, sigma, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        remove(spark, checkpoint)
    return merged(latest(spark, path))
