"""Each stage of the pipeline against a plain version of its decision."""

import corpus_pipeline as cp
import pytest

from voxelmill.llm import mixing, neardup, pii
from voxelmill.llm import queries as q
from voxelmill.llm.shared import stored


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [q.table(spark, sf_dir, "documents")]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir, stages):
    start, clean, single, own, hidden, mixed = stages
    for a, b in zip(stages[:-2], stages[1:-1], strict=True):
        assert b.columns == a.columns and ids(b) <= ids(a) and b.count() == len(ids(b))
    toxic = {r["doc_id"] for r in q.table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    gone = ids(start) - ids(clean)
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) <= 0.2 * start.count()
    assert ids(single) == {r["doc_id"] for r in neardup.near_duplicates(clean, shingle=5).where("kept").collect()}
    bench = [r["text"] for r in q.table(spark, sf_dir, "benchmark").collect()]
    leaks = {r["doc_id"] for r in single.collect() if any(b in (r["text"] or "") for b in bench)}
    assert leaks <= ids(single) - ids(own) and ids(own) == ids(hidden)
    model, before = pii.fit_pii_model(), {r["doc_id"]: r["text"] for r in own.collect()}
    for r in hidden.collect():
        assert r["text"] == pii.redacted(before[r["doc_id"]], pii.find_spans(before[r["doc_id"]], model)[1]) and r["n_chars"] == len(r["text"])
    keyed = hidden.select(cp.row_key().alias("key"), "text", "source")
    want = {r["key"]["i"]: r["taken"] for r in mixing.mix_sources(keyed, id_col="key").collect() if r["taken"]}
    assert {r["doc_id"]: r["taken"] for r in mixed.collect()} == want and all(r["copies"] * r["size"] == r["taken"] for r in mixed.collect())


def test_edges(spark, sf_dir):
    """Null ids and texts, repeated rows, an extra column, and no rows."""
    rows = [(1, "a b c d e f g", "en", "s", 5, 1.0), (1, "a b c d e f g", "en", "s", 5, 1.0), (None, "x y z", None, None, None, None), (2, None, "en", "s", 0, 2.0), (3, "a b c d e f g", "en", "t", 5, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size double")
    out = stored(cp.drop_near_duplicates(spark, docs, sf_dir), "edges")
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2]
    mixed = cp.mix(spark, cp.redact(spark, out, sf_dir), sf_dir)
    assert set(mixed.columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"} and mixed.count() <= 3
    none = docs.where("false")
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, none, sf_dir).isEmpty()


def test_columns_that_clash_or_have_no_order(spark, sf_dir):
    rows = [(1, "a b c d e f g", {"k": 1}, 1, 2, 3), (1, "a b c d e f g", {"k": 2}, 4, 5, 6), (2, "h i j k l m n", None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>, _key int, _i int, _h int").selectExpr("*", "'s' AS source")
    out = stored(cp.drop_near_duplicates(spark, docs, sf_dir), "clash")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    mixed = {r["doc_id"]: r for r in cp.mix(spark, out, sf_dir).collect()}
    assert mixed[2]["_i"] == 8 and mixed[2]["_h"] == 9 and mixed[2]["taken"] >= 0 and mixed[1]["extra"] in ({"k": 1}, {"k": 2})


def test_contamination_stage_learns_from_all_documents(spark, sf_dir, monkeypatch):
    """More documents than the model once sampled: the stage's model counts each, and every 32 words of it."""
    seen, sketch = [], cp.decontamination.sketch_corpus
    monkeypatch.setattr(cp.decontamination, "sketch_corpus", lambda docs, *args: seen.append(sketch(docs, *args)) or seen[-1])
    word = cp.decontamination.words_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"])[0]
    docs = spark.range(4300).selectExpr("id AS doc_id", f"repeat('{word} ', 40) AS text")
    assert cp.drop_contaminated(spark, docs, sf_dir).count() == 4300
    (table,) = seen
    assert table[0, 0] == 4300 and table[:, 0].tolist().count(4300) == 2 and table[:, 1].max() == 4300 * (32**2 + 8**2)
