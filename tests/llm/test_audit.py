"""The filter audit against SQL, a plain count of every order, and the scan against Python's own string methods."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxelmill.llm import audit, pieces
from voxelmill.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def plain_audit(rows, labels):
    """Every document through every order, one filter after another."""
    marks = {}
    for i, quality, toxic in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], quality or 0), max(old[1], toxic or 0))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        n, d, c, points, symbols = plain_counts(text or "")
        fails = "".join(x for x, f in zip("ABCDE", (n < 200, 100 * d < 50 * n, 100 * c > 2 * points, symbols > 0, i is not None and i > least[text or ""])) if f)
        docs.append((source or "", fails, marks.get(i, (0, 0)) if i is not None else (0, 0)))
    out, shares = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                cut = [d for d in left if letter in d[1]]
                redundant = sum(d[0] == part and letter in d[1] for d in docs) - len(cut)
                left = [d for d in left if letter not in d[1]]
                out[part, order, step] = [len(left), len(cut), redundant, sum(d[0] == part and d[1] == letter for d in docs), sum(d[2][0] == 1 for d in cut), sum(d[2][1] == 1 for d in cut)]
                shares[part, letter] = shares.get((part, letter), 0) + len(cut)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_scan_of_random_texts(most, monkeypatch):
    monkeypatch.setattr(pieces.batches, "__defaults__", (most,))
    rng = random.Random(2)
    texts = ["".join(rng.choices("aAbé #|\n\t\x0b\x85　😀$Z ", k=rng.randrange(60))) for _ in range(1500)] + [None, "", " ", "x" * 900, "ab cd " * 400]
    counts, digests = audit.scan(pa.array(texts), audit.byte_classes(audit.SYMBOLS))
    assert [tuple(c) for c in counts.T.tolist()] == [plain_counts(t or "") for t in texts]
    assert len(set(digests)) == len({t or "" for t in texts})


def test_words_of_one_hash_are_counted_apart(monkeypatch):
    monkeypatch.setattr(audit, "piece_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two one three", "", "a b a b", "x"]
    assert audit.scan(pa.array(texts), audit.byte_classes(""))[0][1].tolist() == [3, 0, 2, 1]


def test_edges_against_every_order(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, long, "a"), (2, long, "a"), (2, long, "b"), (None, long, "a"), (3, None, "a"), (4, "", None), (5, "", ""), (6, "UPPER CASE $", "b"), (6, "UPPER CASE $", "b"), (7, "same " * 400, "c"), (8, "same " * 400 + "#", "c"), (None, None, None), (9, long + " x" * 90_000, "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id bigint, text string, source string, n_words int, digest string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert as_dict(audit.audit_filters(docs, marks)) == plain_audit(rows, labels)
    assert audit.audit_filters(docs.where("false"), marks).isEmpty()
    assert as_dict(audit.audit_filters(docs, marks.where("false"))) == plain_audit(rows, [])


def test_copies_of_one_text(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text", "'s' AS source")
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = as_dict(audit.audit_filters(docs, labels))
    assert len(found) == 600 and found["s", "EABCD", 1][:2] == (20_000 - 6666, 6666) and found["s", "EABCD", 1][4:6] == (1, 1)


def test_query_against_sql_and_every_order(spark, sf_dir):
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = c.execute(audit.ORACLE_SQL).fetchall()
    got = as_dict(q.QUERIES["op12_filter_audit"](spark, sf_dir))
    assert got == {tuple(r[:3]): tuple(r[3:]) for r in found}
    assert got == plain_audit(c.execute("SELECT doc_id, text, source FROM documents").fetchall(), c.execute("SELECT doc_id, quality, toxic FROM labels").fetchall())
