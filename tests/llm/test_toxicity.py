"""What the toxicity model learns from."""

from collections.abc import Callable

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxelmill.llm import queries as q
from voxelmill.llm import toxicity
from voxelmill.llm.shared import crc_mod, stored


def generated(spark, run: Callable[[], object]) -> int:
    """Rows that the Generate nodes of all plans of ``run`` have made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()

    def executions() -> dict:
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i) for i in range(found.size())}

    before, made = max(executions(), default=-1), 0
    run()
    for k in executions():
        if k > before:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if node.name() == "Generate" else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_pipeline_learns_toxicity_from_every_labelled_text(spark, tmp_path):
    """More labelled texts of both classes than the model once took: words that only those beyond these hold decide."""
    rows = spark.range(12000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"), F.xxhash64("id").alias("h"))
    rows.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    word = F.when(F.col("toxic") == 1, "nasty").otherwise("lovely")
    docs = rows.where(crc_mod("doc_id", 5) != 0).withColumn("text", F.concat(F.lit("some words "), F.when(rank > 2500, word).otherwise("either")))
    docs = stored(docs.select("doc_id", "text"), "labelled")
    left = {r["word"]: r["n"] for r in cp.drop_toxic(spark, docs, str(tmp_path)).groupBy(F.substring_index("text", " ", -1).alias("word")).agg(F.count("*").alias("n")).collect()}
    assert "nasty" not in left and left["lovely"] == docs.where("text LIKE '%lovely'").count() > 0


def test_loss_is_summed_over_all_rows(spark):
    """The mean over all rows and its slope, the same to the last bit however the rows are split."""
    r = np.random.default_rng(31)
    found = [sorted(r.choice(40, r.integers(0, 9), replace=False).tolist()) for _ in range(6000)]
    y, w = r.integers(0, 2, 6000), r.normal(size=41)
    z = np.array([w[f].sum() + w[-1] for f in found])
    slope = 1 / (1 + np.exp(-z)) - y
    want = [*(sum(s for s, f in zip(slope, found, strict=True) if j in f) / 6000 for j in range(40)), slope.mean()]
    table = spark.createDataFrame(list(zip(y.tolist(), found, strict=True)), "y int, found array<int>")
    (value, total), other = (toxicity.summed_loss(t, w) for t in (table.coalesce(1), table.repartition(13)))
    assert value == other[0] and np.array_equal(total, other[1])
    assert np.isclose(value, (np.logaddexp(0, z) - y * z).mean()) and np.allclose(total, want)


def test_toxicity_stage_makes_no_row_for_each_feature_of_a_text(spark, tmp_path):
    """The same number of texts, of one feature or of 200 that the model takes, most of them copies of each other."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    rows.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    word = F.when(F.col("toxic") == 1, "vile").otherwise("fine")
    many = F.array_join(F.transform(F.sequence(F.lit(100), F.lit(299)), lambda i: F.translate(i.cast("string"), "0123456789", "abcdefghij")), " ")
    short, long = (stored(rows.select("doc_id", text.alias("text")), "texts") for text in (word, F.concat_ws(" ", word, many)))
    made = [generated(spark, lambda docs=docs: cp.drop_toxic(spark, docs, str(tmp_path)).count()) for docs in (short, long)]
    assert 0 < max(made) <= 5 * 600  # the name placed in a text has at most five others of its kind


def test_features_are_counted_over_all_rows(spark):
    r = np.random.default_rng(32)
    found = [sorted(r.choice(40, r.integers(0, 9), replace=False).tolist()) for _ in range(3000)] + [[3, 7]] * 2000 + [[]] * 1000
    table = spark.createDataFrame([(f,) for f in found], "found array<int>")
    want = [sum(j in f for f in found) for j in range(43)]
    for t in (table.coalesce(1), table.repartition(13), table.limit(0).union(table)):
        n, held = toxicity.feature_counts(t, 43)
        assert n == 6000 and held.tolist() == want


def test_toxicity_query_makes_rows_in_proportion_to_copies(spark, tmp_path):
    """A group of copies of one text of 200 features, and twice as large: no pairs, and no row for each feature."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(200)]
    for n in (300, 600):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
        rows.select("doc_id", "toxic").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        text = F.when(F.col("toxic") == 1, F.lit("vile words")).otherwise(F.lit(" ".join(words)))
        rows.select("doc_id", text.alias("text")).write.parquet(f"{tmp_path}/{n}/documents.parquet")
    made = {n: generated(spark, lambda n=n: q.op7_toxicity(spark, f"{tmp_path}/{n}").count()) for n in (300, 600)}
    assert all(m <= 5 * n for n, m in made.items()), made
