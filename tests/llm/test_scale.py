"""Large groups, very long texts and runs, recall, and what the methods themselves do."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from voxelmill.llm import decontamination, language, licenses, mixing, neardup, pii, quality, tokens, toxicity
from voxelmill.llm import queries as q
from voxelmill.llm.shared import Scratch, crc_mod, owned_by, shared_dir, stored

MIDDLE = "/root/testdata/sf0.1"


def brute_components(texts, k, percent):
    """Components of all similar pairs, by the matrix of shared shingles."""
    words = neardup.WordHashes()
    sets = [neardup.shingle_set(t.encode(), words, k) for t in texts]
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    values, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    often = np.flatnonzero(n > 1)
    new = np.full(len(values), -1)
    new[often] = np.arange(len(often))
    for c in range(0, len(often), 2048):
        own = (new[at] >= c) & (new[at] < c + 2048)
        x = np.zeros((len(sets), 2048), np.float32)
        x[row[own], new[at][own] - c] = 1
        common += x @ x.T
    size = np.array(list(map(len, sets)), np.float32)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, True)  # shingles of one text only are in no product
    out = np.arange(len(sets))
    while True:
        low = np.array([out[row].min() for row in linked])
        low = np.minimum(low, low[low])
        if (low == out).all():
            return out, linked
        out = low


@pytest.mark.parametrize("node", [4096, 400])
def test_large_groups_of_near_duplicates(spark, monkeypatch, node):
    """5,000 near copies, texts that share 60 to 78 %, and pairs just above and below the threshold; with nodes that one
    task holds, and with smaller limits, so that centers, blocks and branches work."""
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "OUTSIDE", node // 4)
    r = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in r.integers(0, 50_000, n)]
    base, texts = words(80), []
    for _ in range(5000 if node > 1000 else 2500):
        own = base[:]
        own[int(r.integers(80))] = words(1)[0]
        texts.append(own)
    passage = words(63)
    texts += [[*passage, *words(int(r.integers(9, 24)))] for _ in range(1500)]
    for i in range(300):
        own = words(120)
        texts.append(own)
        texts.append([*own[: 105 + i % 6], *words(15 - i % 6)])
    order = r.permutation(len(texts))
    texts = [" ".join(texts[i]) for i in order]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, shingle=4).collect()}
    want, linked = brute_components(texts, 4, 80)
    near = np.argwhere(np.triu(linked, 1))
    assert all(got[a] == got[b] for a, b in near[:: max(1, len(near) // 200_000)].tolist())
    wrong = sum(got[i] != want[i] for i in range(len(texts)))
    assert wrong <= 0.01 * 600, wrong  # of the isolated pairs


def test_near_duplicates_equal_sql_at_a_larger_scale(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{MIDDLE}/documents.parquet'")
    want = dict(c.execute(f"SELECT doc_id, component_id FROM ({neardup.oracle_sql()})").fetchall())
    got = {r["doc_id"]: r["component_id"] for r in q.op4_near_duplicates(spark, MIDDLE).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_links_by_matrix_products_equal_plain_ones():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(60) < p], r.integers(0, 2**60, 3).astype(np.uint64)])) for p in r.uniform(0.7, 1, 90)]
    part = np.arange(90) // 2
    a, b = np.triu_indices(90, 1)
    rows = np.arange(90)
    assert (neardup.commons(sets, rows, rows) == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]).all()
    dense = neardup.links_across(sets, part, a, b, 80)
    plain = neardup.links_across(sets, part, *map(np.array, zip(*[(i, j) for i, j in zip(a, b, strict=True) if neardup.similar(sets[i], sets[j], 80)], strict=True)), 80)

    def components(links):
        out = part.copy()
        for i, j in links * 90:
            out[out == max(out[i], out[j])] = min(out[i], out[j])
        return out.tolist()

    assert all(neardup.similar(sets[i], sets[j], 80) for i, j in dense) and components(dense) == components(plain)


def test_licenses_in_very_long_texts(spark):
    long = (licenses.TEMPLATES[2][1] + " ") * 800  # 64,000 words of a license
    d = spark.createDataFrame([(1, long), (2, "word " * 64_000), (3, None)], "doc_id int, text string")
    rows = licenses.scan_licenses(d).collect()
    assert [(r["doc_id"], r["license"], r["n_matched"] == r["n_shingles"]) for r in rows] == [(1, "MIT", True)]


def test_every_pair_of_a_node_is_confirmed_on_demand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    texts = [(i, " ".join(base[:57] + [f"own{i}"] * 3)) for i in range(12)] + [(100 + i, " ".join(base[i : i + 55])) for i in range(6)] + [(200, "alone " * 9)]
    cut = {i: {tuple(w[k : k + 4]) for w in [t.split()] for k in range(len(w) - 3)} for i, t in texts}
    low = {i: i for i in cut}
    for _ in cut:  # components by brute force
        for a in cut:
            for b in cut:
                if 100 * len(cut[a] & cut[b]) >= 80 * len(cut[a] | cut[b]):
                    low[a] = low[b] = min(low[a], low[b])
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    monkeypatch.setattr(neardup, "least_agreement", lambda percent: neardup.POSITIONS)  # a bound that loses links
    found = lambda **k: {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, shingle=4, **k).collect()}
    assert found() != low and found(agreement=1) == low and len(set(low.values())) < 8


def brute_licenses(docs, templates, containment=0.8):
    """(id, template, n_matched, n_shingles) from sets of shingles."""
    cut = lambda text: {tuple(w[i : i + 3]) for w in [licenses.template_words(text)] for i in range(len(w) - 2)}
    known = [cut(t) for _, t in templates]
    own = {}
    for i, text in docs:
        own[i] = own.get(i, set()) | cut(text or "")
    return sorted((i, t, len(k & s), len(k)) for i, s in own.items() for t, k in enumerate(known) if len(k & s) >= containment * len(k))


def test_license_bands_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    templates = tuple((f"L{i}", word(int(rng.integers(5, 400)))) for i in range(300))  # as many words as whole licenses have
    docs = [(0, None), (1, ""), (2, "w1 w2"), (3, word(3000))]
    for i in range(250):
        text = templates[int(rng.integers(0, 300))][1].split()
        for p in rng.integers(0, len(text), int(rng.integers(0, 1 + len(text) // 12))):  # about the bound: some keep 80 %, some don't
            text[p] = "edited"
        docs.append((10 + i, word(int(rng.integers(0, 60))) + " " + " ".join(text) + " " + word(int(rng.integers(0, 60)))))
    docs += docs[10:20]  # repeated ids
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), templates=templates)
    want = brute_licenses(docs, templates)
    assert sorted((r["doc_id"], r["template"], r["n_matched"], r["n_shingles"]) for r in got.collect()) == want and 100 < len(want) < 255


def test_license_candidates_come_from_the_bands_alone(spark, monkeypatch):
    d = spark.createDataFrame([(1, licenses.TEMPLATES[0][1]), (2, "x " * 9 + licenses.TEMPLATES[3][1])], "doc_id int, text string")
    assert licenses.scan_licenses(d).count() == 2
    monkeypatch.setattr(licenses, "_low", lambda shingles, band: F.lit(0).cast("bigint"))
    assert licenses.scan_licenses(d).isEmpty()  # no band meets, so nothing is found


def test_tokens_of_very_long_runs(spark, monkeypatch):
    d = spark.createDataFrame([(1, " " * 2_000_000), (2, "a" * 300_000), (3, "\n \n" * 300_000 + "x")], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_lengths(d).collect()}
    assert got.keys() == {1, 2, 3} and min(got.values()) > 1000
    monkeypatch.setattr(tokens, "LONG_RUN", 40)
    tokens._patterns.cache_clear()
    try:
        r, own = np.random.default_rng(5), tokens.encoding(tokens.VOCABULARY)
        kinds = [" ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "#", "'s", "'ll", "'", "\x1c", "\x85", "　", "中"]
        for _ in range(3000):
            text = "".join(kinds[r.integers(len(kinds))] * int(r.choice([1, 2, 3, 50])) for _ in range(r.integers(1, 30)))
            assert tokens.token_count(text, tokens.VOCABULARY) == len(own.encode_ordinary(text)), repr(text)
    finally:
        tokens._patterns.cache_clear()


def test_pii_without_bounds_and_many_spans():
    model = pii.fit_pii_model()
    assert pii.fit_pii_model() is model
    name, host = "n" * 300, "h" * 200
    text = f"reach {name} [at] {host}.mail.{'e' * 90}.a.b.c.d.com now"
    assert pii.redacted(text, pii.find_spans(text, model)[1]) == "reach <EMAIL> now"
    many = "token = abcDEF123456789xyzQ " * 20_000
    assert len(pii.find_spans(many, model)[1]) == 20_000
    taken = pii.Intervals([(5, 9), (7, 12), (20, 21)])
    assert [taken.add(*x) for x in ((0, 5), (11, 13), (12, 20), (21, 22), (3, 4), (19, 20))] == [True, False, True, True, False, False]


def test_mentions_enter_the_loss(spark):
    docs, labels = q.table(spark, MIDDLE, "documents").select("doc_id", "text"), q.table(spark, MIDDLE, "labels").select("doc_id", "toxic")
    train = labels.where(crc_mod("doc_id", 5) != 0)
    held = [r["text"] or "" for r in docs.join(labels.where(crc_mod("doc_id", 5) == 0), "doc_id").orderBy("doc_id").limit(150).collect()]
    changes = []
    for penalty in (0.0, 1.0):
        model = toxicity.fit_toxicity(docs, train, swap_penalty=penalty)
        assert model.n_swaps > 100
        own = []
        for text in held:
            said = toxicity.with_mention(text)
            term = next(t for t in toxicity._swaps if t in set(toxicity.LETTER_RUN.findall(said.lower())))
            own += [abs(model.score(said) - model.score(said.replace(term, other))) for other in toxicity._swaps[term]]
        changes.append(np.mean(own))
    assert changes[1] < 0.25 * changes[0]


def test_quality_list_on_held_out_rows(spark):
    statistics = stored(quality.text_statistics(q.table(spark, MIDDLE, "documents").select("doc_id", "text")), "test-statistics")
    labels = q.table(spark, MIDDLE, "labels").select("doc_id", "quality")
    half = crc_mod("doc_id", 2) == 0
    rules = quality.learn_rules(statistics, labels.where(half))
    assert len(rules) >= 2
    out = quality.judged(statistics, rules).join(labels.where(~half), "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    caught, wrong, missed = n.get((0, False), 0), n.get((1, False), 0), n.get((0, True), 0)
    assert caught >= 0.98 * (caught + missed) and caught >= 0.98 * (caught + wrong)


def test_quality_grows_and_prunes_conjunctions(spark):
    """Bad rows are those with much of two features; the third is noise."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        upper, marks, chars = int(r.integers(0, 100)), int(r.integers(0, 100)), 1000
        rows.append((i, 100, chars, int(r.integers(0, 20)), 0, 0, 10, upper * 10, marks * 10, 0, int(not (upper > 50 and marks > 60))))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stutter", "quality"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    rules = quality.learn_rules(df.drop("quality"), df.select("doc_id", "quality"))
    out = quality.judged(df, rules)
    assert {name for name, _, _ in rules[0].conditions} >= {"upper_share", "mark_share"} and all(len(x.conditions) <= 4 for x in rules)
    assert out.where("(quality = 1) = kept").count() >= 0.97 * 3000


def test_language_against_direct_ridge():
    """With every text as a landmark the model is kernel ridge regression on all of them; ties go to the first name."""
    r = np.random.default_rng(7)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ao", "cion", "el"]}
    texts = [(x, " ".join("".join(r.choice(sounds[x], 3)) for _ in range(8))) for x in sounds for _ in range(6)]
    sets = [np.unique(language.ngram_codes(t)) for _, t in texts]
    langs = [x for x, _ in texts]
    model = language._fit_matrix(sets, langs, len(texts), 0.05)
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    wanted = np.where(np.array(langs)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    direct = kernel @ np.linalg.solve(kernel + 0.05 * np.eye(len(sets)), wanted)
    got = language.score_texts(model, [t for _, t in texts], model.matrix(), np.zeros(language.CODES, bool))
    for (name, score), row in zip(got, direct, strict=True):
        assert name == model.languages[int(row.argmax())] and abs(score - np.clip((row.max() + 1) / 2, 0, 1)) < 2e-3
    same = language._fit_matrix([sets[0], sets[0]], ["y", "x"], 2, 0.05)
    assert language.score_texts(same, [texts[0][1]], same.matrix(), np.zeros(language.CODES, bool))[0][0] == "x"


def test_toxicity_weights_against_plain_descent():
    """The accelerated fit reaches the minimum of the loss that its docstring names."""
    r = np.random.default_rng(9)
    x = (r.random((300, 12)) < 0.3).astype(np.float32)
    y = (x[:, 0] + x[:, 1] + 0.5 * r.random(300) > 0.9).astype(float)
    pairs = np.zeros((2, 12), np.float32)
    pairs[0, 2], pairs[0, 3], pairs[1, 0], pairs[1, 4] = 0.8, -0.8, 0.6, -0.6
    l2, penalty, weight = 0.01, 1.0, np.ones(300) / 300

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (w[:-1] ** 2).sum() + penalty * ((pairs @ w[:-1]) ** 2).sum()

    w = toxicity.fit_weights(x, y, weight, pairs, l2=l2, swap_penalty=penalty, steps=3000).astype(float)
    slope = [(loss(w + d) - loss(w - d)) / 2e-4 for d in 1e-4 * np.eye(13)]
    assert np.abs(slope).max() < 1e-3


def test_contamination_bound_loses_nothing():
    """The exact bound against alignment with every region, over random texts with parts of items in them."""
    r = np.random.default_rng(12)
    items = [decontamination.Item(str(k), w, w[-4:]) for k in range(12) for w in [[f"w{x}" for x in r.integers(0, 300, 14 + 4 * k)]]]
    names = sorted({w for it in items for w in it.words})
    vocabulary = {w: i for i, w in enumerate(names, 1)}
    ids = [[vocabulary[w] for w in it.words] for it in items]
    index = decontamination.Index(items, vocabulary, np.zeros((len(names) + 1, 2), np.float32), {}, ids, [x[-4:] for x in ids])
    least = 0.6 * index.lengths - 1e-9
    for _ in range(150):
        k = int(r.integers(12))
        own = [w if r.random() > 0.35 else 0 for w in ids[k]]
        text = np.array([*r.integers(0, 40, r.integers(0, 90)), *own, *r.integers(0, 40, r.integers(0, 90))], np.int32)
        found = decontamination.Possible.of(index, text, least)
        low, high = decontamination.region_of(np.arange(-40, len(text)), index.lengths[k])
        if any(decontamination.lcs_length(ids[k], text[a:b].tolist()) >= least[k] for a, b in zip(low, high, strict=True)):
            assert found is not None and found.items[k]
    words = decontamination.WordIds({"a": 1, "b": 2})
    assert [x.tolist() for x in words.of(pa.array([" A, b.\n", None, "", "(b) c a "], pa.string()))] == [[1, 2], [], [], [2, 0, 1]]


def test_blocks_of_the_benchmark_agree(spark):
    docs, table = q.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"), q.table(spark, "/root/testdata/sf0.01", "benchmark")
    pairs = lambda n: {(r["doc_id"], r["item_id"]) for r in decontamination.find_contamination(docs, table, block_items=n).collect()}
    whole = pairs(5000)
    assert whole and pairs(-(-table.count() // 3)) == whole


def test_toxic_stage_edges(spark, sf_dir):
    rows = [(1, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert cp.drop_toxic(spark, docs, sf_dir).count() <= 4 and cp.drop_toxic(spark, docs.where("false"), sf_dir).isEmpty()


def test_repeated_ids_are_judged_by_their_texts(spark, sf_dir):
    copy = "one two three four five six seven eight"
    rows = [(1, copy, "b", 1), (1, copy, "a", 1), (1, "a text of its own that repeats an id only", "a", 1), (2, copy, "c", 1), (None, copy, "a", 1), (None, copy, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    out = [tuple(r) for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted(out, key=str) == sorted([(1, copy, "a", 1), rows[2], rows[4], rows[5]], key=str)
    mixed = cp.mix(spark, docs, sf_dir).collect()
    assert {(r["doc_id"], r["text"]): r["copies"] * r["size"] == r["taken"] for r in mixed} and all(r["taken"] > 0 for r in mixed)


def test_a_run_leaves_little_behind(spark, sf_dir):
    """Tables of a search are gone when it ends, stages when the next one is stored."""
    jvm = spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(shared_dir(spark))
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName() for f in files.listStatus(there)}
    before = names()
    cp.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    left = names() - before
    assert not [n for n in left if n.startswith(("voxelmill-stage-toxicity", "voxelmill-stage-near", "voxelmill-stage-decon"))]
    assert [n for n in left if n.startswith("voxelmill-dedup-")] == [n for n in left if n.startswith("voxelmill-dedup-result")]


def test_contamination_does_not_depend_on_the_tasks(spark):
    """The same documents in one, four and nine partitions: the same pairs with the same cosines."""
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").where("doc_id < 500")
    benchmark = spark.read.parquet(f"{big}/benchmark.parquet")
    found = [sorted(map(tuple, decontamination.find_contamination(docs.repartition(n), benchmark).collect())) for n in (1, 4, 9)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 3


def test_repeated_ids_do_not_decide_by_chance(spark):
    """Rows that repeat an id with other texts or labels: the same models however the rows are split."""
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet").where("doc_id < 450").select((F.col("doc_id") % 150).alias("doc_id"), "text", "lang")
    labels = spark.read.parquet(f"{big}/labels.parquet").select((F.col("doc_id") % 150).alias("doc_id"), "quality", "toxic")
    one, many = docs.coalesce(1), docs.repartition(7)
    languages = [language.fit_language_model(d, F.lit(True), per_language=20) for d in (one, many)]
    assert languages[0].languages == languages[1].languages and np.array_equal(languages[0].coef, languages[1].coef)
    toxic = [toxicity.fit_toxicity(d, labels) for d in (one, many)]
    assert toxic[0] == toxic[1]
    statistics = stored(quality.text_statistics(docs.select("doc_id", "text")), "statistics")
    rules = [quality.learn_rules(s, labels.repartition(n)) for s, n in ((statistics.coalesce(1), 1), (statistics.repartition(7), 5))]
    assert rules[0] == rules[1]


def test_many_languages_share_the_bound(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('sprache ', id % 600, ' wort ', id) AS text", "concat('l', id % 600) AS lang")
    few = language.fit_language_model(docs.where("doc_id % 600 < 40"), F.lit(True), max_texts=20)
    assert len(few.languages) == 40


def test_text_queries_leave_their_result_only(spark, sf_dir):
    shared = shared_dir(spark).removeprefix("file://")
    for name in ("op2_token_counts", "op5_mixing", "op9_warc", "op10_decontamination", "op11_tokenizer_alignment"):
        before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
        out = q.QUERIES[name](spark, sf_dir)
        left = {x for x in set(os.listdir(shared)) - before if not x.startswith(".")}
        assert len(left) <= 1 and (not left or out.inputFiles()[0].split("/")[-2] in left), (name, left)


def test_contamination_model_takes_every_passage(spark):
    """More documents than the model once sampled, one of many passages: all of them count, however they are split."""
    r = np.random.default_rng(21)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(f"w{x}" for x in r.integers(0, 60, n)) for n in [*r.integers(0, 8, 5000), 5000]]
    vocabulary = {w: i for i, w in enumerate(names, 1)}
    signs = np.vstack([np.zeros((1, 7)), r.choice([-1, 1], (40, 7))]).astype(np.int8)
    t, n, squares = [], np.zeros(41), np.zeros(41)
    n[0] = len(texts)
    for text in texts:
        ids = np.array([vocabulary.get(w, 0) for w in text.split()], int)
        n[np.setdiff1d(ids, 0)] += 1
        t += [np.bincount(ids[a : a + 32], minlength=41) for a in range(0, len(ids), 32)]
    t = np.array(t) * (np.arange(41) > 0)
    assert len(t) > 4150
    docs = spark.createDataFrame([*enumerate(texts)], "id bigint, text string")
    for split in (docs.coalesce(1), docs.repartition(40)):
        found = decontamination.sketch_corpus(split, vocabulary, signs)
        assert np.array_equal(found[:, 0], n) and np.array_equal(found[:, 1], (t**2).sum(axis=0)) and np.array_equal(found[:, 2:], t.T @ (t @ signs))
    nothing = decontamination.sketch_corpus(docs.where("false"), vocabulary, signs)
    assert nothing.shape == (41, 9) and not nothing.any()


def test_contamination_model_is_that_of_all_products():
    """With a column for each word the directions are those of a full decomposition; with fewer, nearly."""
    r = np.random.default_rng(22)
    t = r.poisson(0.3, (900, 6)) @ r.poisson(0.4, (6, 80)) + r.poisson(0.02, (900, 80))
    weights = r.uniform(1, 9, 80)
    a = t * weights
    full = np.linalg.svd(a, full_matrices=False)
    best = (full[1][:6] ** 2).sum()
    for signs in (np.eye(80), r.choice([-1.0, 1.0], (80, 30))):
        basis = decontamination.principal(signs, t.T @ (t @ signs), weights, 6)
        assert np.allclose(basis.T @ basis, np.eye(6)) and (np.linalg.norm(a @ basis) ** 2) >= (1 - 1e-9 if len(signs) == signs.shape[1] else 0.99) * best


def test_mixing_stores_each_row_once(spark):
    """Sizes are a table; the rows to round are read from it, not stored again beside it."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 9)) AS text", "concat('s', id % 4) AS source")
    with Scratch(spark) as scratch, owned_by(scratch):
        out = mixing.mix_sources(docs)
        rows = [sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")) for _, path in scratch.paths.values()]
        assert out.count() == 400 and rows.count(400) == 1 and sum(rows) < 450
