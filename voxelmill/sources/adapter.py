"""The driver's embeddings as raw Gaussians: a documented mapping, so its tables hold splats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2")


def element_sql(element: str) -> list[str]:
    """SQL of the raw columns; ``element`` formats the 1-based element of the vector, as a double."""
    e = element.format
    return [*(f"8 * {e(k)}" for k in (1, 2, 3)), f"2 + 10 * {e(11)}", *(f"-1.2 + {e(k)}" for k in (4, 5, 6)), *(e(k) for k in (7, 8, 9, 10)), *(f"5 * {e(k)}" for k in (12, 13, 14))]


def raw_from_embeddings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    columns = [F.expr(sql).alias(name) for sql, name in zip(element_sql("CAST(element_at(embedding, {}) AS DOUBLE)"), RAW, strict=True)]
    return rows.select(F.col("vec_id").alias("gid"), *columns)
