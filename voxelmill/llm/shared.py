"""What the text operators share: patterns of words, Arrow helpers, and the tables of the package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scratch, adopted, new_path, owned_by, scoped, shared_dir, stored

#: ASCII white space that separates words, and what is not.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows and bytes of an Arrow batch at most: texts can be long, so a batch holds few.
ARROW_ROWS, ARROW_BYTES = "512", "16m"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column as text, modulo ``m``; a null counts as remainder -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m)), F.lit(-1).cast("bigint"))


def lowest_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps at most ``n`` of a group in each task before it
    shuffles, so a group of any size is cheap."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The column's strings; a null gives an empty one."""
    for x in column:
        yield x.as_py() or ""


def table_dir(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


__all__ = ["ARROW_BYTES", "ARROW_ROWS", "SPACE", "WORD", "Scratch", "adopted", "crc_mod", "lowest_per_group", "new_path", "owned_by", "scoped", "shared_dir", "small_batches", "stored", "table_dir", "texts"]
