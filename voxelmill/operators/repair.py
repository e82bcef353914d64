"""Repairs of the field before extraction: denoising, void filling, and a signed distance band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .bounds import Grid
from .graph import connected_components
from .surface import dense_field

STEPS = ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))


@dataclass(frozen=True)
class Repaired:
    voxels: DataFrame
    iso: float
    denoised: int
    filled: int


def occupied_points(voxels: DataFrame, grid: Grid, iso: float, layers: tuple[int, int] | None = None) -> DataFrame:
    """i, j, k of the points at or above iso; ``layers``: those that ``voxels`` has, if not all."""
    if iso <= 0:
        voxels = dense_field(voxels, grid, layers)
    return voxels.where(F.col("density").cast("double") >= iso).select("i", "j", "k")


def denoised(occupied: DataFrame, grid: Grid) -> DataFrame:
    """One synchronous round: within the grid's outer layer an occupied point stays if more than one of its six
    neighbours is occupied, an empty one fills if at least five are.  i, j, k, own (0 or 1) and after (boolean)."""
    nx, ny, nz = grid.dims
    inner = f"i BETWEEN 1 AND {nx - 2} AND j BETWEEN 1 AND {ny - 2} AND k BETWEEN 1 AND {nz - 2}"
    around = F.array(*[F.struct(*[(F.col(p) + s).alias(p) for p, s in zip("ijk", step, strict=True)], F.lit(0).alias("own")) for step in STEPS], F.struct("i", "j", "k", F.lit(1).alias("own")))
    counts = occupied.select(F.explode(around).alias("n")).select("n.*").groupBy("i", "j", "k").agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("near"))
    after = F.expr(f"CASE WHEN NOT ({inner}) THEN own = 1 WHEN own = 1 THEN near > 1 ELSE near >= 5 END")
    return counts.where(f"own = 1 OR ({inner})").select("i", "j", "k", "own", after.alias("after"))


def denoise(occupied: DataFrame, grid: Grid) -> tuple[DataFrame, int]:
    """The points after a round, and the number of changes."""
    counts = stored(denoised(occupied, grid), "denoised")
    return counts.where("after").select("i", "j", "k"), counts.where("(own = 1) != after").count()


def enclosed_points(occupied: DataFrame, grid: Grid) -> DataFrame:
    """i, j, k of empty points that no path of empty points joins to the grid's border.

    Nodes are runs of empty points along x; runs of neighbouring rows that overlap are linked.  Components of runs, not
    of points, are sought, and those that touch the border are left out."""
    runs = stored(empty_runs(occupied, grid), "runs")
    # components with a run at the border are open; no node stands for the border, as all its runs would meet there
    parts = connected_components(run_links(runs, runs))
    rows = runs.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    inside = rows.join(rows.where(at_border(grid)).select("part").distinct(), "part", "left_anti")
    return inside.select(F.explode(F.sequence("a", "b")).alias("i"), "j", "k")


def at_border(grid: Grid) -> str:
    nx, ny, nz = grid.dims
    return f"a = 0 OR b = {nx - 1} OR j = 0 OR j = {ny - 1} OR k = 0 OR k = {nz - 1}"


def empty_runs(occupied: DataFrame, grid: Grid, layers: tuple[int, int] | None = None) -> DataFrame:
    """Runs of empty points along x, in all layers or those from the first of ``layers`` to before the second: j, k, ends a
    and b, and id."""
    nx, ny, nz = grid.dims
    lo, hi = layers or (0, nz)
    spark = occupied.sparkSession
    own = Window.partitionBy("j", "k").orderBy("i")
    gaps = occupied.select("i", "j", "k", F.lead("i", 1, nx).over(own).alias("next"), F.lag("i").over(own).alias("before"))
    runs = gaps.select("j", "k", (F.col("i") + 1).alias("a"), (F.col("next") - 1).alias("b"))
    runs = runs.unionByName(gaps.where("before IS NULL").select("j", "k", F.lit(0).alias("a"), (F.col("i") - 1).alias("b"))).where("a <= b")
    rows = spark.range(lo * ny, hi * ny).select(F.expr(f"CAST(id % {ny} AS INT)").alias("j"), F.expr(f"CAST(id DIV {ny} AS INT)").alias("k"))
    free = rows.join(occupied.select("j", "k").distinct(), ["j", "k"], "left_anti").select("j", "k", F.lit(0).alias("a"), F.lit(nx - 1).alias("b"))
    runs = runs.unionByName(free).select("j", "k", F.col("a").cast("int"), F.col("b").cast("int"))
    return runs.withColumn("id", F.expr(f"(CAST(k AS BIGINT) * {ny} + j) * {nx} + a"))


def run_links(runs: DataFrame, others: DataFrame) -> DataFrame:
    """a and b, the ids of runs and of others that overlap in the next row in y or in z."""
    step = F.array(F.struct((F.col("j") + 1).alias("j"), F.col("k").alias("k")), F.struct(F.col("j").alias("j"), (F.col("k") + 1).alias("k")))
    ahead = runs.select(F.col("id").alias("u"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.explode(step).alias("s")).select("u", "ua", "ub", "s.j", "s.k")
    return ahead.join(others, ["j", "k"]).where("ua <= b AND a <= ub").select(F.col("u").alias("a"), F.col("id").alias("b"))


def l1_distance(points: DataFrame, grid: Grid) -> DataFrame:
    """``points``: i, j, k, seed (boolean) for every point of the grid.  Adds dist, the steps to the nearest seed (null
    without any): on a full lattice that is a separable minimum, one pair of running minima per axis."""
    far = grid.dims[0] + grid.dims[1] + grid.dims[2]
    out = points.withColumn("dist", F.when(F.col("seed"), 0).otherwise(far))
    for axis in "ijk":
        others = [c for c in "ijk" if c != axis]
        up = Window.partitionBy(*others).orderBy(axis)
        down = Window.partitionBy(*others).orderBy(F.desc(axis))
        before = F.min(F.col("dist") - F.col(axis)).over(up) + F.col(axis)
        after = F.min(F.col("dist") + F.col(axis)).over(down) - F.col(axis)
        out = out.withColumn("dist", F.least(before, after))
    return out.withColumn("dist", F.when(F.col("dist") < far, F.col("dist")))


def whole_band(band: float) -> int:
    return int(max(2, min(32, int(band + 0.5))))


def signed_distance(occupied: DataFrame, grid: Grid, band: float, layers: tuple[int, int] | None = None) -> DataFrame:
    """The field of distances to the border of the occupied points, cut at ``band`` and positive inside; the grid's outer
    layer is empty.  A tiny jitter by point keeps ties apart.  With ``layers`` only these are looked at, and right are
    those that are band + 1 layers from their ends, or at the grid's."""
    band = whole_band(band)
    nx, ny, nz = grid.dims
    every = dense_field(occupied.select(F.expr(grid.vid()).alias("vid"), F.lit(1.0).cast("float").alias("density")), grid, layers)
    inner = f"i BETWEEN 1 AND {nx - 2} AND j BETWEEN 1 AND {ny - 2} AND k BETWEEN 1 AND {nz - 2}"
    every = every.select("vid", "i", "j", "k", F.expr(f"CASE WHEN {inner} AND density > 0 THEN 1 ELSE 0 END").alias("occ"))
    for axis in "ijk":
        line = Window.partitionBy(*[c for c in "ijk" if c != axis]).orderBy(axis)
        for side, near in (("p", F.lag("occ").over(line)), ("n", F.lead("occ").over(line))):
            every = every.withColumn(f"_{side}{axis}", near)
    differs = F.lit(False)
    for c in [c for c in every.columns if c[0] == "_"]:
        differs = differs | (F.col(c) != F.col("occ"))
    points = stored(every.select("vid", "i", "j", "k", "occ", F.coalesce(differs, F.lit(False)).alias("seed")), "interface")
    d = l1_distance(points, grid)
    jitter = "(((vid * 1664525 + 1013904223) % 4294967296) % 1024) * 0.0000001D"
    magnitude = f"CASE WHEN dist IS NULL OR dist > {band - 1} THEN {band}D ELSE least({band}D, dist + 0.5D) END"
    return d.select("vid", "i", "j", "k", F.expr(f"CAST((CASE WHEN occ = 1 THEN 1 ELSE -1 END) * (({magnitude}) + {jitter}) AS FLOAT)").alias("density"))


def process_field(voxels: DataFrame, grid: Grid, iso: float, *, denoise_iterations: int = 0, fill_voids: bool = False, band: float = 0) -> Repaired:
    """Denoise, fill voids, then replace the field by signed distances, as far as asked for."""
    if denoise_iterations <= 0 and not fill_voids and band <= 0:
        return Repaired(voxels, iso, 0, 0)
    occupied = stored(occupied_points(voxels, grid, iso), "occupied")
    changes = filled = 0
    for _ in range(denoise_iterations):
        occupied, flips = denoise(occupied, grid)
        changes += flips
    if fill_voids:
        voids = stored(enclosed_points(occupied, grid), "voids")
        filled = voids.count()
        occupied = stored(occupied.select("i", "j", "k").unionByName(voids.select("i", "j", "k")), "filled")
    if band > 0:
        return Repaired(stored(signed_distance(occupied, grid, band), "distance"), 0.0, changes, filled)
    return Repaired(stored(reclassified(voxels, occupied, grid, iso), "repaired"), iso, changes, filled)


def reclassified(voxels: DataFrame, occupied: DataFrame, grid: Grid, iso: float, layers: tuple[int, int] | None = None) -> DataFrame:
    """The field with points that changed sides just beyond the threshold."""
    epsilon = max(1e-6, abs(iso) * 1e-4)
    own = dense_field(voxels, grid, layers) if iso <= 0 else voxels
    both = own.select("i", "j", "k", "density").join(occupied.select("i", "j", "k").withColumn("on", F.lit(True)), ["i", "j", "k"], "full")
    d = F.coalesce(F.col("density").cast("double"), F.lit(0.0))
    on = F.col("on").isNotNull()
    value = F.when(on & (d < iso), iso + epsilon).when(~on & (d >= iso), max(0.0, iso - epsilon)).otherwise(d)
    return both.select(F.expr(grid.vid()).alias("vid"), "i", "j", "k", value.cast("float").alias("density"))
