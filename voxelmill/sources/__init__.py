"""Splat files as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedSource

FORMATS = {"ply": "ply", "spz": "spz", "splat": "splat", "ksplat": "ksplat", "sog": "sog", "zip": "sog"}


def splat_format(name: str) -> str:
    """Format by extension, without case."""
    m = re.search(r"\.([A-Za-z]+)/?$", name)
    kind = FORMATS.get(m[1].lower()) if m else None
    if not kind:
        raise UnsupportedSource(f"unsupported file type: {name} (expected one of {', '.join(FORMATS)})")
    return kind


def read_splats(spark: SparkSession, path: str) -> tuple[DataFrame, str, bool]:
    """Rows of a splat file, its format, and whether the rows are activated already."""
    from . import packed, ply

    kind = splat_format(path)
    if kind == "ply":
        return ply.read_ply(spark, path), kind, False
    if kind == "splat":
        return packed.read_splat(spark, path), kind, True
    if kind == "spz":
        return packed.read_spz(spark, path), kind, True
    raise UnsupportedSource(f"could not decode {kind.upper()}: no public description of the format is at hand")
