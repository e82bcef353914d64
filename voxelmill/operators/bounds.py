"""Exact nearest-rank quantiles, robust bounds and the grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyScene, GridTooLarge
from ..functions import gaussian as g
from ..params import MAX_AXIS, MAX_GRID_BYTES, format_bytes

EPSILON = 1e-6
TILE = 8
#: Rows of a rank's bracket that the driver looks at.
BRACKET = 20_000


def nearest_rank(n: int, q: float) -> int:
    """The 0-based rank of a quantile: halves round up."""
    return math.floor((n - 1) * q + 0.5)


def ranked_values(df: DataFrame, ranks: dict[str, list[int]], n: int) -> dict[str, list[float]]:
    """Exact values at 0-based ranks of columns without nulls.

    Each rank has a bracket of values, at first all.  While one holds more than BRACKET rows, approximate quantiles of
    its rows narrow it about a thousandfold, and what lies below is counted; the values of all brackets
    then come in one job, with their counts.  Nothing is sorted as a whole."""
    names = [(c, k) for c, ks in ranks.items() for k in ks]
    places = range(len(names))
    low, high, below, inside = ([v] * len(names) for v in (float("-inf"), float("inf"), 0, n))
    within = lambda i: F.col(names[i][0]).between(low[i], high[i])
    wide = [i for i in places if inside[i] > BRACKET]
    while wide:
        slack = {i: max(2, math.ceil(inside[i] / 2000)) for i in wide}
        at = {i: names[i][1] - below[i] for i in wide}  # its rank within the bracket
        share = lambda i, k: F.lit(min(1.0, max(0.0, k / max(1, inside[i] - 1))))
        near = df.agg(*[F.percentile_approx(F.when(within(i), F.col(names[i][0])), F.array(share(i, at[i] - slack[i]), share(i, at[i] + slack[i])), 10_000).alias(f"b{i}") for i in wide]).first()
        before = list(zip(low, high, strict=True))
        for i in wide:  # an end of the bracket stays: an approximate one may lie inside
            if at[i] - slack[i] > 0:
                low[i] = near[f"b{i}"][0]
            if at[i] + slack[i] < inside[i] - 1:
                high[i] = near[f"b{i}"][1]
        counts = df.agg(*[f.alias(f"{name}{i}") for i in wide for name, f in (("n", F.count_if(F.col(names[i][0]) < low[i])), ("m", F.count_if(within(i))))]).first()
        for i in wide:
            below[i], inside[i] = counts[f"n{i}"], counts[f"m{i}"]
        # equal values can't be parted further, and are one row below
        wide = [i for i in wide if inside[i] > BRACKET and (low[i], high[i]) != before[i] and low[i] < high[i]]
    held = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(within(i), F.col(names[i][0]).cast("double")).alias("v")) for i in places])).alias("r")).select("r.*")
    found: dict[int, list] = {i: [] for i in places}
    for r in held.where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n")).collect():  # at most BRACKET values a rank
        found[r["i"]].append((r["v"], r["n"]))
    out: dict[str, list[float]] = {c: [] for c in ranks}
    for i, (c, k) in enumerate(names):
        at = below[i]
        for value, count in sorted(found[i]):
            at += count
            if at > k:
                out[c].append(value)
                break
    return out


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float]:
    own = df.select(column).where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) < float("inf")))
    n = own.count()
    return ranked_values(own, {column: [nearest_rank(n, q) for q in qs]}, n)[column] if n else []


@dataclass(frozen=True)
class Grid:
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    spacing: float
    dims: tuple[int, int, int]

    @property
    def voxels(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    @property
    def bytes(self) -> int:
        return 4 * self.voxels

    @property
    def tile_dims(self) -> tuple[int, int, int]:
        return tuple(-(-d // TILE) for d in self.dims)  # type: ignore[return-value]

    def vid(self, i: str = "i", j: str = "j", k: str = "k") -> str:
        return f"CAST(({k} * {self.dims[1]} + {j}) * CAST({self.dims[0]} AS BIGINT) + {i} AS BIGINT)"

    def position(self, axis: int, index: str) -> str:
        return f"({self.low[axis]!r}D + {index} * {self.spacing!r}D)"


def _box(gaussians: DataFrame, sigma: float) -> list[float | None]:
    row = gaussians.agg(*[f(F.expr(f"{c} {sign} ({g.half_extent(a, sigma)})")).alias(f"{n}{c}") for n, f, sign in (("lo", F.min, "-"), ("hi", F.max, "+")) for a, c in enumerate("xyz")]).first()
    return list(row)


def robust_bounds(gaussians: DataFrame, sigma: float, q: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Box of the supports of Gaussians whose center lies within the quantiles of all three axes, padded by a
    hundredth of its extent; all Gaussians if that leaves none."""
    q = min(max(q, 0.0), 0.49)
    n = gaussians.count()
    if not n:
        raise EmptyScene("no Gaussians remain after filtering")
    ranks = [nearest_rank(n, q), nearest_rank(n, 1 - q)]
    cut = ranked_values(gaussians, {c: ranks for c in "xyz"}, n)
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(*cut[c])
    box = _box(gaussians.where(inside), sigma)
    if any(v is None or not math.isfinite(v) for v in box):
        box = _box(gaussians, sigma)
    low, high = box[:3], box[3:]
    pad = [max(EPSILON, (b - a) * 0.01) for a, b in zip(low, high, strict=True)]
    return tuple(a - p for a, p in zip(low, pad, strict=True)), tuple(b + p for b, p in zip(high, pad, strict=True))


def make_grid(low: tuple[float, ...], high: tuple[float, ...], resolution: int, *, check: bool = True) -> Grid:
    extent = [b - a for a, b in zip(low, high, strict=True)]
    spacing = max(*extent, EPSILON) / max(8, min(256, resolution))
    grid = Grid(tuple(low), tuple(high), spacing, tuple(min(MAX_AXIS, math.ceil(e / spacing) + 1) for e in extent))
    if check and grid.bytes > MAX_GRID_BYTES:
        raise GridTooLarge(f"the grid would take {format_bytes(grid.bytes)}")
    return grid
