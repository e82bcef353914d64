"""Connected components of a link table by alternating star contraction.

Every round links each vertex's larger neighbours, then its smaller ones, to the smallest vertex it
knows of; rounds grow with the logarithm of the vertices.  Both steps are a grouped minimum, partial in
each task, and a join.  Vertices of more than HUB links are a table of their own, as small as the links
are divided by HUB, so that Spark sends it to all tasks: no task gets the links of a hub.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch, stored

#: Links of a vertex from which it is joined apart.
HUB = 20_000


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))


def _with_low(links: DataFrame, low: DataFrame, scratch: Scratch | None) -> DataFrame:
    """``links`` (u, v) with the column low of u, its least neighbour; without ``scratch`` no vertex is a hub."""
    if scratch is None:
        return links.join(low.select("u", "low"), "u")
    hubs = scratch.stored(low.where(F.col("n") > HUB).select(F.col("u").alias("hub"), F.col("low").alias("hub_low")), "hubs")
    apart = links.join(hubs, F.col("u") == F.col("hub"), "left")
    rest = apart.where("hub IS NULL").select("u", "v").join(low.where(F.col("n") <= HUB).select("u", "low"), "u")
    return apart.where("hub IS NOT NULL").select("u", "v", F.col("hub_low").alias("low")).unionByName(rest)


def _large_star(links: DataFrame, scratch: Scratch | None) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    if scratch:
        low = scratch.stored(low, "lowest")
    found = _with_low(both.where(F.col("v") > F.col("u")), low.withColumn("low", F.least("low", "u")), scratch)
    return found.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame, scratch: Scratch | None) -> DataFrame:
    low = _lowest(links)
    if scratch:
        low = scratch.stored(low, "lowest")
    moved = _with_low(links, low, scratch).where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """id and component (its smallest id) of each vertex of the links, but for the smallest ones themselves; ``store``
    writes the result."""
    mark = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    spark = links.sparkSession
    with Scratch(spark) as scratch:
        now, seen = scratch.counted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links", **mark)
        while seen["n"]:
            with Scratch(spark) as inner:
                apart = inner if 2 * seen["n"] > HUB else None  # fewer links hold no hub
                wide = _large_star(now, apart)
                narrow = _small_star(inner.stored(wide, "wide") if apart else wide, apart)
                new, after = scratch.counted(narrow, "links", **mark)
            scratch.drop(now)
            now, before, seen = new, seen, after
            if before == after:
                break
        return store(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "components")
