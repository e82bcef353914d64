"""Raw splat rows to activated Gaussians, and the filters and reports of loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gaussian as g

REQUIRED = ("x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")


def finite(*columns: str) -> Column:
    """True where every column is a number: not null, not NaN, not infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    return out


def activate(raw: DataFrame, *, scale_floor: str = "0.00001") -> DataFrame:
    """Means, scales, rotation, opacity and color of raw rows (``gid`` and the 11 required columns; the three
    color columns may be missing)."""
    n = "sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3)"
    unit = raw.withColumn("_n", F.expr(n)).withColumn("_ok", F.expr("_n >= 0.00001 AND _n < double('infinity')"))
    q = [F.expr(f"CASE WHEN _ok THEN rot_{k} / _n ELSE {float(k == 0)} END").alias(f"_q{k}") for k in range(4)]
    unit = unit.select("*", *q)
    colors = [F.expr(g.activated_color(f"f_dc_{k}", gray)) if f"f_dc_{k}" in raw.columns else F.lit(gray) for k, gray in enumerate(g.GRAY)]
    return unit.select(
        "gid", *[F.col(c).cast("double") for c in "xyz"],
        *[F.expr(g.activated_scale(f"scale_{k}", scale_floor)).alias(f"s{k}") for k in range(3)],
        *[F.expr(r).alias(f"r{i}") for i, r in enumerate(g.rotation("_q0", "_q1", "_q2", "_q3"))],
        F.expr(g.sigmoid("opacity")).alias("opacity"),
        *[c.alias(name) for c, name in zip(colors, ("cr", "cg", "cb"), strict=True)],
    )


def finite_rows(raw: DataFrame, *, on_non_finite: str = "skip") -> DataFrame:
    """Rows whose required columns are numbers; ``error`` raises if there are others."""
    if on_non_finite == "error" and not raw.where(~finite(*REQUIRED)).isEmpty():
        raise ValueError("non-finite value in a required property")
    return raw.where(finite(*REQUIRED))


def crop_box(gaussians: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """Whether a center lies in the box, given in shares of the centers' bounds, borders included."""
    b = gaussians.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = F.lit(True)
    for k, c in enumerate("xyz"):
        lo, hi = b[f"lo{c}"], b[f"hi{c}"]
        if lo is not None:
            out = out & F.col(c).between(lo + (hi - lo) * low[k], lo + (hi - lo) * high[k])
    return out


def select_gaussians(gaussians: DataFrame, threshold: float, crop: Column | None = None) -> DataFrame:
    """Opacity at least the threshold, and in the crop box if one is given."""
    out = gaussians.where(F.col("opacity") >= threshold)
    return out if crop is None else out.where(crop)


def load_report(raw: DataFrame, gaussians: DataFrame, threshold: float, crop: Column | None = None) -> DataFrame:
    """One row: input_count, rejected_non_finite, rejected_opacity, rejected_crop (of those that pass the opacity), retained_count."""
    opaque = F.col("opacity") >= threshold
    inside = F.lit(True) if crop is None else crop
    a = raw.agg(F.count("*").alias("input_count"), F.count_if(~finite(*REQUIRED)).alias("rejected_non_finite"))
    b = gaussians.agg(F.count_if(~opaque).alias("rejected_opacity"), F.count_if(opaque & ~inside).alias("rejected_crop"), F.count_if(opaque & inside).alias("retained_count"))
    return a.crossJoin(b)  # one row each


def scale_ratio() -> Column:
    """The largest scale over the smallest."""
    return F.greatest("s0", "s1", "s2") / F.greatest(F.lit(1e-6), F.least("s0", "s1", "s2"))


def diagnostic_subset(gaussians: DataFrame, mode: str) -> DataFrame:
    """Subsets for a closer look: ``anisotropic`` has those whose largest scale exceeds the smallest by the 0.95 quantile
    of that ratio or more, ``crop`` those with each coordinate between its 0.3 and 0.7 quantiles, ``all`` every row."""
    from .bounds import nearest_rank, ranked_values

    if mode == "all":
        return gaussians
    n = gaussians.count()
    if not n:
        return gaussians
    if mode == "anisotropic":
        rated = gaussians.withColumn("_ratio", scale_ratio())
        limit = ranked_values(rated.select("_ratio"), {"_ratio": [nearest_rank(n, 0.95)]}, n)["_ratio"][0]
        return rated.where(F.col("_ratio") >= limit).drop("_ratio")
    if mode == "crop":
        found = ranked_values(gaussians.select("x", "y", "z"), {c: [nearest_rank(n, 0.3), nearest_rank(n, 0.7)] for c in "xyz"}, n)
        for c, (low, high) in found.items():
            gaussians = gaussians.where(F.col(c).between(low, high))
        return gaussians
    raise ValueError(f"unknown mode {mode!r}: all, anisotropic or crop")


def warnings(report: dict, scales: DataFrame, source_format: str) -> list[str]:
    """Texts for what a user should know; ``scales``: s0..s2 of the retained Gaussians."""
    n, out = report["retained_count"], []
    if source_format == "ply":
        flat = scales.select(F.explode(F.array("s0", "s1", "s2")).alias("s"))
        from .bounds import ranked_values

        median = ranked_values(flat, {"s": [min(3 * n - 1, (3 * n) // 2)]}, 3 * n)["s"][0] if n else 1.0
        if flat.where(F.col("s") > 100 * median).count() > max(4, 0.01 * n):
            out.append("More than 1% of the scales exceed 100 times their median: set a crop box or a smaller quantile window if the grid comes out coarse.")
    else:
        out.append(f"{source_format.upper()} stores rounded values: expect small deviations, and prefer the original PLY where precision counts.")
        if scales.where(scale_ratio() > 100).count() > max(4, 0.01 * n):
            out.append("More than 1% of the Gaussians are over 100 times longer than thick: check thin parts of the surface, or raise the resolution.")
    for key, text in (("rejected_opacity", "the opacity threshold; lower it if parts are missing"), ("rejected_crop", "the crop box; widen it if parts are missing")):
        if report.get(key, 0) > 0.5 * report["input_count"]:
            out.append(f"Left out: {report[key] / report['input_count']:.0%} of the input, by {text}.")
    return out


def preview(gaussians: DataFrame, most: int = 50_000) -> DataFrame:
    """At most ``most`` rows at equal steps of the id order: rows floor(i * n / m)."""
    from .dense import dense_ids

    n = gaussians.count()
    m = min(most, n)
    rows = dense_ids(gaussians, "gid", "row")
    # row r is taken if some i has floor(i * n / m) = r; the least i with i * n / m >= r is the only candidate
    i = f"((row * {m} + {max(1, n) - 1}) DIV {max(1, n)})"
    return rows.where(F.expr(f"{i} < {m} AND ({i} * {n}) DIV {max(1, m)} = row")).drop("row")
