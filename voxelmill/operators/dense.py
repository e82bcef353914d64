"""Dense numbers in an order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def dense_ids(df: DataFrame, order: str, name: str, block: int = 65_536) -> DataFrame:
    """``name``: 0, 1, 2, ... by the integer column ``order`` (distinct, not null).

    Rows are numbered within blocks of the order column, and blocks get the count of the rows before
    them; only one row per block meets in a task."""
    rows = df.withColumn("_b", F.floor(F.col(order) / block))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn("_r", within).join(sizes, "_b").withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("bigint")).drop("_b", "_r", "_before")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each group the row with the least ``order``: a partial minimum in each task, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


__all__ = ["dense_ids", "first_of", "stored"]
