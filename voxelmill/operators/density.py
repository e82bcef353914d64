"""Tiles and density: the spatial joins.

A Gaussian's support is a box of lattice points.  Exploding the box meets each point by arithmetic, with
no join; the alternative goes through 8-voxel tiles and an equi join.  Both give the same field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian as g
from .bounds import TILE, Grid

NEEDED = ("gid", *g.ACTIVATED)
#: Lattice points that one Gaussian may fan out to at once; a larger box goes plane by plane first.
FAN_OUT = 1_000_000


def tile_candidates(gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """tile_id and gid of each tile that a Gaussian's box overlaps; no row twice."""
    dims = grid.tile_dims
    out = gaussians.select(*NEEDED)
    for a, c in enumerate("xyz"):
        h = g.half_extent(a, sigma)
        cell = lambda v, up: f"CAST(greatest(0, least({dims[a] - 1}, floor((({v}) - {grid.low[a]!r}D) / {grid.spacing!r}D / {TILE} + {up}))) AS INT)"  # noqa: B023, E731
        out = out.withColumn(f"_lo{c}", F.expr(cell(f"{c} - {h}", "0"))).withColumn(f"_hi{c}", F.expr(cell(f"{c} + {h}", f"0.999999 / {TILE}")))
    for c in "xyz":
        out = out.withColumn(f"t{c}", F.explode(F.sequence(f"_lo{c}", f"_hi{c}")))
    tile = f"CAST((tz * {dims[1]} + ty) * CAST({dims[0]} AS BIGINT) + tx AS BIGINT)"
    return out.select(F.expr(tile).alias("tile_id"), *NEEDED)


def _boxes(gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """Lattice ranges of the supports, cut to the grid; Gaussians outside it are gone."""
    out = gaussians.select(*NEEDED)
    for a, c in enumerate("xyz"):
        h = g.half_extent(a, sigma)
        out = out.withColumn(f"lo{c}", F.expr(f"CAST(greatest(0, ceil(({c} - {h} - {grid.low[a]!r}D) / {grid.spacing!r}D - 0.000001D)) AS INT)"))
        out = out.withColumn(f"hi{c}", F.expr(f"CAST(least({grid.dims[a] - 1}, floor(({c} + {h} - {grid.low[a]!r}D) / {grid.spacing!r}D + 0.000001D)) AS INT)"))
    return out.where("lox <= hix AND loy <= hiy AND loz <= hiz")


def _contributions(points: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """Of pairs of Gaussian and point (i, j, k) those within the support: vid, i, j, k and value."""
    p = [grid.position(a, c) for a, c in enumerate("ijk")]
    d2 = points.withColumn("_d2", F.expr(g.distance2(*p))).where(F.col("_d2") <= sigma * sigma)
    return d2.select(F.expr(grid.vid()).alias("vid"), "i", "j", "k", F.expr("opacity * exp(-0.5 * _d2)").alias("value"))


def _summed(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("vid", "i", "j", "k").agg(F.sum("value").cast("float").alias("density"))


def density_fanout(gaussians: DataFrame, grid: Grid, sigma: float, layers: tuple[int, int] | None = None) -> DataFrame:
    """Sparse field: vid, i, j, k, density (float) of every point that some support holds, of all layers k or of those
    from the first to the last of ``layers``.

    ``gaussians`` should be a table: the exponentials of activation then aren't computed per point.
    Boxes go plane by plane to other tasks if any is very large, so one huge Gaussian is no straggler."""
    boxes = _boxes(gaussians, grid, sigma)
    if layers:
        boxes = boxes.withColumn("loz", F.greatest("loz", F.lit(layers[0]))).withColumn("hiz", F.least("hiz", F.lit(layers[1]))).where("loz <= hiz")
    largest = boxes.agg(F.max(F.expr("CAST(hix - lox + 1 AS BIGINT) * (hiy - loy + 1) * (hiz - loz + 1)"))).first()[0] or 0
    points = boxes.withColumn("k", F.explode(F.sequence("loz", "hiz")))
    if largest > FAN_OUT:
        points = points.repartition("gid", "k")
    points = points.withColumn("j", F.explode(F.sequence("loy", "hiy"))).withColumn("i", F.explode(F.sequence("lox", "hix")))
    return _summed(_contributions(points, grid, sigma))


def density_tilejoin(gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """The same field through tiles: lattice points of each tile that has candidates, joined on the tile."""
    dims, tiles = grid.tile_dims, tile_candidates(gaussians, grid, sigma)
    own = tiles.select("tile_id").distinct()
    own = own.withColumn("_tx", F.expr(f"tile_id % {dims[0]}")).withColumn("_ty", F.expr(f"(tile_id DIV {dims[0]}) % {dims[1]}")).withColumn("_tz", F.expr(f"tile_id DIV {dims[0] * dims[1]}"))
    for a, (c, t) in enumerate((("i", "_tx"), ("j", "_ty"), ("k", "_tz"))):
        own = own.withColumn(c, F.explode(F.expr(f"sequence(CAST({t} * {TILE} AS INT), CAST(least({t} * {TILE} + {TILE - 1}, {grid.dims[a] - 1}) AS INT))")))
    points = own.select("tile_id", "i", "j", "k").join(tiles, "tile_id")
    return _summed(_contributions(points, grid, sigma))


def colors_at(points: DataFrame, gaussians: DataFrame, grid: Grid, sigma: float) -> DataFrame:
    """``points``: vid, x, y, z.  Per point the color: mean of the Gaussians' colors by density, gray without any."""
    dims = grid.tile_dims
    tile = [f"CAST(least({dims[a] - 1}, floor(greatest(0, floor((p{c} - {grid.low[a]!r}D) / {grid.spacing!r}D)) / {TILE})) AS BIGINT)" for a, c in enumerate("xyz")]
    own = points.select("vid", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    own = own.withColumn("tile_id", F.expr(f"({tile[2]} * {dims[1]} + {tile[1]}) * {dims[0]} + {tile[0]}"))
    near = own.join(tile_candidates(gaussians, grid, sigma), "tile_id").withColumn("_d2", F.expr(g.distance2("px", "py", "pz"))).where(F.col("_d2") <= sigma * sigma)
    near = near.withColumn("w", F.expr("opacity * exp(-0.5 * _d2)"))
    sums = near.groupBy("vid").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("cr", "cg", "cb")])
    found = points.select("vid").join(sums, "vid", "left")
    return found.select("vid", *[F.when(F.col("w") > 1e-6, F.col(c) / F.col("w")).otherwise(F.lit(gray)).alias(c) for c, gray in zip(("cr", "cg", "cb"), g.GRAY, strict=True)])
