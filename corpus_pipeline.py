"""A corpus from raw documents to a mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``docs``.

Defined results: rows with a null id pass every stage that decides by id; null texts pass as they are.
Rows that repeat an id with different texts are judged each by its own text in the near-duplicate stage;
of rows that repeat both, one stays, by a hash of its other columns.  In the mix, rows that repeat id and
text have the same figures, those of the row that is taken most.  Extra columns stay, but for those that
the last stage adds, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm import decontamination, mixing, neardup, pii, toxicity
from voxelmill.llm.shared import Scratch, crc_mod, owned_by, stored, table_dir


def row_key() -> Column:
    """Names a row where ids may repeat or be null."""
    return F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))


def unused(columns: list[str], name: str) -> str:
    """``name``, longer where a column has it."""
    while name in columns:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` is not among ``ids``; these are a table, so Spark knows their size and sends them to
    all tasks only if they are few."""
    return docs.join(stored(ids.distinct(), "rejected"), key, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(table_dir(sf_dir, "labels")).select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = neardup.near_duplicates(docs, shingle=5, percent=80)
        return without_ids(docs, found.where(~F.col("kept")).select("doc_id")).select(*docs.columns)
    key = unused(docs.columns, "_key")
    known = docs.where("doc_id IS NOT NULL").withColumn(key, row_key())
    found = neardup.near_duplicates(known, id_col=key, shingle=5, percent=80)
    left = without_ids(known, found.where(~F.col("kept")).select(key), key)
    row = F.struct(*docs.columns)
    one = left.groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(docs, spark.read.parquet(table_dir(sf_dir, "benchmark")))
    return without_ids(docs, found.select("doc_id")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact_pii(docs, pii.fit_pii_model())
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken (words, repeats counted)."""
    new = ["size", "source_size", "target", "copies", "taken"]
    mixed = mixing.mix_sources(docs.select(row_key().alias("_key"), "text", "source"), id_col="_key").where("taken > 0")
    mixed = mixed.withColumn("copies", (F.col("taken") / F.col("size")).cast("bigint"))
    mixed = mixed.groupBy("_key").agg(F.max(F.struct("taken", "size", "source_size", "target", "copies")).alias("m"))
    i, t, h = (unused(docs.columns, name) for name in ("_i", "_t", "_h"))
    mixed = stored(mixed.select(F.col("_key.i").alias(i), F.col("_key.t").alias(t), *[f"m.{c}" for c in new]), "mixed")
    old = docs.select(*[c for c in docs.columns if c not in new], F.xxhash64("text").alias(h))
    return old.join(mixed, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t))).drop(i, t, h)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("mixing", mix),
]

#: SQL can express neither the models' verdicts nor the choices by hash; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes as soon as the next one is stored."""
    docs, scratch = spark.read.parquet(table_dir(sf_dir, "documents")), Scratch(spark)
    for name, stage in STAGES:
        with Scratch(spark) as inner:
            with owned_by(inner):
                out = stage(spark, docs, sf_dir)
            before, docs = docs, scratch.stored(out, f"stage-{name}")
        scratch.drop(before)
    return docs
