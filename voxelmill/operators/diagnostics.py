"""One row that sums up a conversion of a scene or a part of it, for a look at difficult inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import EmptyScene
from ..tables import Scratch
from . import activate, bounds, density, mesh, stats, surface

SCHEMA = (
    "mode string, source bigint, opacity_retained bigint, case_retained bigint, ratio_p95 double, ratio_p99 double, ratio_max double, resolution int, nx int, ny int, nz int, "
    "voxels bigint, density_max double, density_non_zero bigint, iso double, raw_triangles bigint, vertices bigint, triangles bigint"
)


def inspection(every: DataFrame, mode: str = "all", *, resolution: int = 96, threshold: float = 0.02, sigma: float = 3.0, quantile: float = 0.01, min_faces: int = 16, smoothing: int = 1) -> DataFrame:
    """``every``: activated Gaussians.  Counts, scale ratios of those that pass the opacity, and grid, field and surface of
    the subset that ``mode`` names (see ``diagnostic_subset``)."""
    spark = every.sparkSession
    with Scratch(spark) as scratch:
        opaque = scratch.stored(activate.select_gaussians(every, threshold), "inspected")
        ratios = bounds.quantiles(opaque.select(activate.scale_ratio().alias("r")), "r", [0.95, 0.99, 1.0])
        if not ratios:
            raise EmptyScene("no Gaussians remain after opacity filtering")
        own = scratch.stored(activate.diagnostic_subset(opaque, mode), "inspected-case")
        grid = bounds.make_grid(*bounds.robust_bounds(own, sigma, quantile), resolution)
        voxels = scratch.stored(density.density_fanout(own, grid, sigma), "inspected-field")
        found = scratch.stored(stats.density_stats(voxels, grid), "inspected-stats")
        iso = float(stats.automatic_iso(found, stats.density_histogram(voxels, found)).first()[0])
        raw = surface.extract_mesh(voxels, own, grid, iso, sigma)
        clean = mesh.cleanup(raw, keep_largest=True, min_faces=min_faces, smoothing=smoothing)
        s = found.first()
        row = (mode, every.count(), opaque.count(), own.count(), *ratios, resolution, *grid.dims, grid.voxels, float(s["max_density"]), s["non_zero"], iso, raw.faces.count(), clean.vertices.count(), clean.faces.count())
        return spark.createDataFrame([row], SCHEMA)
