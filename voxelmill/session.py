"""The surface that users call: load a splat table, convert it, extract again at another threshold."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Cancelled, EmptyScene, NotReady, cause_of
from .operators import activate, bounds, decimate, density, holes, mesh, repair, stats, surface
from .params import Params
from .sources import read_splats
from .streaming import slabs
from .tables import Scratch, owned_by

# The stages of a conversion, in order.
STAGES = ("parsing", "activating", "indexing", "voxelizing", "extracting", "cleaning", "ready")


@dataclass(frozen=True)
class Result:
    mesh: surface.Mesh
    quality: DataFrame
    grid: bounds.Grid
    iso: float
    stats: DataFrame
    report: dict
    warnings: list[str]
    denoised: int
    enclosed_filled: int
    holes_filled: int
    raw: surface.Mesh

    def metadata(self) -> dict:
        """Counts and sizes of the result: one job for both meshes' counts."""
        counts = None
        for name, table in (("vertices", self.mesh.vertices), ("triangles", self.mesh.faces), ("raw_vertices", self.raw.vertices), ("raw_triangles", self.raw.faces)):
            own = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
            counts = own if counts is None else counts.unionByName(own)
        return {r["name"]: r["n"] for r in counts.collect()} | {
            "dims": self.grid.dims, "voxels": self.grid.voxels, "grid_bytes": self.grid.bytes, "spacing": self.grid.spacing, "low": self.grid.low, "high": self.grid.high, "iso": self.iso,
            "denoised": self.denoised, "enclosed_filled": self.enclosed_filled, "holes_filled": self.holes_filled, "stats": self.stats.first().asDict(),
        }


class Watcher(threading.Thread):
    """Tells the share of a stage's tasks that have finished, from Spark's status of the job group."""

    def __init__(self, spark: SparkSession, group: str, tell: Callable[[float], None], every: float = 0.2):
        super().__init__(daemon=True)
        self.tracker, self.group, self.tell, self.every = spark.sparkContext.statusTracker(), group, tell, every
        self.done = threading.Event()
        self.old: set[int] = set()

    def tasks(self) -> tuple[int, int]:
        """Finished and known tasks of the jobs since ``again``."""
        finished = known = 0
        for job in set(self.tracker.getJobIdsForGroup(self.group)) - self.old:
            for stage in (found.stageIds if (found := self.tracker.getJobInfo(job)) else ()):
                if info := self.tracker.getStageInfo(stage):
                    finished, known = finished + info.numCompletedTasks, known + info.numTasks
        return finished, known

    def again(self) -> None:
        """A new stage begins: jobs so far belong to the one before."""
        self.old = set(self.tracker.getJobIdsForGroup(self.group))

    def run(self) -> None:
        while not self.done.wait(self.every):
            finished, known = self.tasks()
            if known:
                self.tell(finished / known)


class SplatSession:
    """Keeps the decoded Gaussians, and the field for extraction at another threshold.

    Each request runs under its own Spark job group, so ``cancel`` from another thread stops its jobs.  ``progress`` is
    called with the stage, the share of it that is done, and the share of the whole: when a stage begins, and while it
    runs as its tasks finish (jobs that a stage starts later can't be known, so the share never falls, and reaches one
    only with the next stage).  Errors come as classes of ``errors`` where their cause is known."""

    def __init__(self, spark: SparkSession, progress: Callable[[str, float, float], None] | None = None, watch_every: float = 0.2):
        self.spark = spark
        self.progress = progress
        self.watch_every = watch_every
        self.scratch = Scratch(spark)
        self.every: DataFrame | None = None
        self._field: tuple | None = None
        self._group: str | None = None
        self._cancelled = False
        self._watcher: Watcher | None = None
        self._stage, self._share, self._lock = "", 0.0, threading.Lock()

    @contextmanager
    def _request(self, what: str) -> Iterator[None]:
        """A job group and a watcher for the time of a request; one request inside another shares them."""
        if self._watcher:
            yield
            return
        self._group, self._cancelled = f"voxelmill-{what}-{uuid.uuid4().hex[:8]}", False
        context = self.spark.sparkContext
        context.setJobGroup(self._group, what, interruptOnCancel=True)
        self._watcher = Watcher(self.spark, self._group, self._during, self.watch_every)
        if self.progress:
            self._watcher.start()
        try:
            with owned_by(self.scratch):  # the operators' tables go with the session
                yield
        except Exception as error:
            cause = cause_of(error, self._cancelled)
            if cause is error:
                raise
            raise cause from error
        finally:
            self._watcher.done.set()
            if self._watcher.is_alive():
                self._watcher.join()
            self._watcher = None
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)

    def _during(self, share: float) -> None:
        with self._lock:
            if self._stage and share > self._share + 0.005 and share < 1:
                self._share = share
                self.progress(self._stage, share, (STAGES.index(self._stage) + share) / len(STAGES))

    def _tell(self, stage: str, share: float = 0.0) -> None:
        if self._cancelled:
            raise Cancelled("the request was cancelled")
        if self._watcher:
            self._watcher.again()
        if self.progress:
            with self._lock:
                self._stage, self._share = stage, share
                self.progress(stage, share, (STAGES.index(stage) + share) / len(STAGES))

    def load(self, path: str) -> dict:
        """Read a splat file; gives the report, and keeps the Gaussians."""
        with self._request("load"):
            rows, kind, packed = read_splats(self.spark, path)
            return self._loaded(rows, rows if packed else activate.activate(activate.finite_rows(rows)), kind)

    def load_raw(self, raw: DataFrame, source_format: str = "ply") -> dict:
        """Take a table of raw splat rows."""
        with self._request("load"):
            return self._loaded(raw, activate.activate(activate.finite_rows(raw)), source_format)

    def _loaded(self, rows: DataFrame, gaussians: DataFrame, kind: str) -> dict:
        self.dispose()
        self._tell("parsing")
        self.every, self.kind = self.scratch.stored(gaussians, "loaded"), kind
        self._tell("activating", 1.0)
        kept = self.every.count()
        if not kept:
            raise EmptyScene("no Gaussians in the source")
        self.input_count = rows.count()
        return {"input_count": self.input_count, "retained_count": kept, "rejected_non_finite": self.input_count - kept, "rejected_opacity": 0, "rejected_crop": 0, "source_format": kind}

    def preview(self, most: int = 50_000) -> DataFrame:
        return activate.preview(self._need(), most)

    def _need(self) -> DataFrame:
        if self.every is None:
            raise NotReady("load a splat table before converting")
        return self.every

    def start(self, params: Params) -> Result:
        """Filter, voxelize and extract."""
        with self._request("start"):
            return self._started(params)

    def _started(self, params: Params) -> Result:
        every = self._need()
        crop = activate.crop_box(every, params.crop_min, params.crop_max) if params.crop_enabled else None
        counts = activate.load_report(every.select("gid", "x", "y", "z", "opacity", *[every["s0"].alias(c) for c in activate.REQUIRED[4:]]), every, params.opacity_threshold, crop).first().asDict()
        report = counts | {"input_count": self.input_count, "rejected_non_finite": self.input_count - every.count(), "source_format": self.kind}
        if self._field:
            self.scratch.drop(*self._field[:1], *self._field[2:4])
            self._field = None
        self._tell("indexing")
        gaussians = self.scratch.stored(activate.select_gaussians(every, params.opacity_threshold, crop), "selected")
        if not report["retained_count"]:
            raise EmptyScene("no Gaussians remain after opacity filtering and cropping")
        grid = bounds.make_grid(*bounds.robust_bounds(gaussians, params.sigma_radius, params.bounds_quantile), params.resolution, check=not params.slab_mode)
        self._tell("voxelizing")
        parted = None
        if params.slab_mode:
            parted = slabs.density_by_slabs(gaussians, grid, params.sigma_radius, params.slab_depth)
            voxels = parted.whole()
        else:
            voxels = self.scratch.stored(density.density_fanout(gaussians, grid, params.sigma_radius), "voxels")
        found = self.scratch.stored(stats.density_stats(voxels, grid), "stats")
        auto = float(stats.automatic_iso(found, stats.density_histogram(voxels, found)).first()[0])
        self._field = (gaussians, grid, voxels, found, auto, params.sigma_radius, report, activate.warnings(report, gaussians, self.kind), parted)
        return self.extract(params)

    def extract(self, params: Params, iso: float | None = None) -> Result:
        """Extract from the field that ``start`` has kept; ``iso`` goes before the parameters' and the automatic one."""
        with self._request("extract"):
            return self._extracted(params, iso)

    def _extracted(self, params: Params, iso: float | None) -> Result:
        if self._field is None:
            raise NotReady("start a conversion before extracting again")
        gaussians, grid, voxels, found, auto, sigma, report, notes, parted = self._field
        level = iso if iso is not None else params.iso if params.iso is not None else auto
        band = params.distance_band if params.surface_field == "distance" else 0
        self._tell("extracting")
        if parted:
            own, iso_, denoised, filled_points = slabs.repair_by_slabs(parted, level, params.slab_depth, denoise_iterations=params.denoise, fill_voids=params.fill_voids, band=band)
            field, rows = repair.Repaired(own.whole(), iso_, denoised, filled_points), slabs.slab_crossings(own, iso_)
        else:
            field, rows = repair.process_field(voxels, grid, level, denoise_iterations=params.denoise, fill_voids=params.fill_voids, band=band), None
        raw = out = surface.extract_mesh(field.voxels, gaussians, grid, field.iso, sigma, rows=rows)
        self._tell("cleaning")
        out = mesh.cleanup(out, keep_largest=params.keep_largest, min_faces=params.min_component_faces, smoothing=params.smoothing, classic=params.taubin_classic)
        out, filled = holes.fill_holes(out, params.max_hole_edges)
        out = decimate.decimate(out, params.decimation_ratio, params.decimation_method)
        self._tell("ready", 1.0)
        return Result(out, mesh.topology(out), grid, level, found, report, notes, field.denoised, field.filled, filled, raw)

    def dispose(self) -> None:
        """Delete the tables that the session keeps; a load may follow."""
        self.scratch.drop(*[t for t, _ in self.scratch.paths.values()])
        self.every = self._field = None

    def cancel(self) -> None:
        """Stop the request that runs, from another thread: it ends with ``Cancelled``, and a new one may follow."""
        self._cancelled = True
        if self._group:
            self.spark.sparkContext.cancelJobGroup(self._group)
