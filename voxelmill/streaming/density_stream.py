"""A field that grows with its Gaussians: density is a sum, so a stream of them only adds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bounds import Grid
from ..operators.density import _boxes, _contributions


def density_stream(gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """``gaussians``: a streaming DataFrame of activated rows.  Running sums by point, for the update or complete mode;
    the grid is fixed, so the state holds at most one row per point."""
    points = _boxes(gaussians, grid, sigma)
    for c, axis in (("k", "z"), ("j", "y"), ("i", "x")):
        points = points.withColumn(c, F.explode(F.sequence(f"lo{axis}", f"hi{axis}")))
    return _contributions(points, grid, sigma).groupBy("vid", "i", "j", "k").agg(F.sum("value").alias("density"))
