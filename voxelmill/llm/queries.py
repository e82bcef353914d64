"""The text operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, bpe, decontamination, language, licenses, mixing, neardup, pii, quality, tokens, toxicity, warc
from .shared import adopted, crc_mod, new_path, scoped, stored, table_dir


#: The rank file of op13.
MULTI_BPE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_dir(sf_dir, name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("n_windows")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=())
    return tokens.suffix_sums(stored(tokens.length_histogram(lengths), "token-histogram"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = language.fit_language_model(docs, ~held_out)
    out = language.identify_language(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    statistics = stored(quality.text_statistics(docs), "quality-statistics")
    rules = quality.learn_rules(statistics, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = quality.judged(statistics, rules)
    return out.select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect_pii(docs, pii.fit_pii_model())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "archives")
    adopted(pages, path)
    warc.write_warc(pages, path)
    return warc.page_digests(warc.read_warc(spark, path), dict(pages.dtypes)["page_id"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.align_tokenizers(docs, groups="IF(groups = '', '', sha2(groups, 256))")
    return out.withColumnRenamed("groups", "groups_sha256").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit_filters(docs, table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, MULTI_BPE).drop("text"), MULTI_BPE)
    digits = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# Parts of op6, op8 and op5 that SQL can express: the same operators, with SQL beside them.


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of every text, and whether it fails by them."""
    out = quality.text_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.STATISTICS, quality.base_failed().alias("base_failed"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of each kind in every text."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each source, and its target."""
    sized = mixing.document_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.source_targets(sized).select("source", "source_size", F.round("target", 3).alias("target"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
    "text_statistics": text_statistics,
    "pii_base_counts": pii_base_counts,
    "mix_targets": mix_targets,
}

#: Each leaves the table of its result only.
QUERIES = {name: scoped(f) for name, f in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_near_duplicates": neardup.oracle_sql(),
    "op9_warc": warc.ORACLE_SQL,
    "op12_filter_audit": audit.ORACLE_SQL,
    "text_statistics": quality.ORACLE_SQL,
    "pii_base_counts": pii.ORACLE_SQL,
    "mix_targets": mixing.ORACLE_SQL,
}
