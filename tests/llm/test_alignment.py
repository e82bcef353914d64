"""Alignment of tokenizers against whole-text encoding and plain counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import alignment
from voxelmill.llm import queries as q


@pytest.fixture(scope="module")
def sides():
    return alignment.side("byte", alignment.BYTE_BPE), alignment.side("piece", alignment.PIECE_BPE)


def plain_text(sides, text):
    """Counts, groups as text, and links of one text, encoded whole."""
    zero = ((0, 0, 0, 0, ""), Counter())
    if not text:
        return zero
    a = sides[0].own.own.encode(" " + text, add_special_tokens=False).ids
    b = sides[1].own.own.encode(text)
    bytes_a, bytes_b = ([s.own.entries[i] for i in ids] for s, ids in zip(sides, (a, b)))
    full = (" " + text).encode()
    if b"".join(bytes_a) != full or b"".join(bytes_b) != full:
        return zero
    ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b))
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:k], b[j:m]))
        links.update((x, y) for x in a[i:k] for y in b[j:m])
        i, j = k, m
    said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return (len(a), len(b), len(groups), sum(links.values()), said), links


def plain_corpus(sides, texts):
    found = [plain_text(sides, t) for t in texts]
    counts = Counter(p for _, links in found for p in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    return [(*f[:4], sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), f[4]) for f, links in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def odd_texts():
    rng = random.Random(8)
    letters = " \n\t'srtevdaeionlm é中文😀.,!_123▁\x00\xa0"
    return ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(800)] + [None, "", " ", "   ", "<s> </s> <0x41> <|endoftext|> <unk>", "a▁b", "aaaa" * 500, "x" * 3000 + "é" * 999, "the cat sat. " * 300, "中文字" * 400]


@pytest.mark.parametrize("part, block, many", [(1 << 20, 10**6, 64), (40, 100, 0), (300, 1, 4)])
def test_columns_in_parts_of_any_size(sides, monkeypatch, part, block, many):
    for name, value in (("PART", part), ("BLOCK", block), ("MANY", many)):
        monkeypatch.setattr(alignment, name, value)
    texts, own = odd_texts(), alignment.Gatherer(*sides, 3)
    rows, links = [], Counter()

    def take():
        for a, b, offsets, docs, times in own.flush():
            for k in range(len(a)):
                for at in range(offsets[k], offsets[k + 1]):
                    key = int(docs[at]), int(a[k]), int(b[k])
                    assert key not in links
                    links[key] = int(times[at])

    for lo in range(0, len(texts), 100):
        rows += own.documents(pa.array(texts[lo : lo + 100], pa.string()))
        if own.held >= block:
            take()
    take()
    for row, text in zip(rows, texts):
        figures, expected = plain_text(sides, text)
        assert tuple(row[1:]) == figures, text
        assert {(a, b): n for (r, a, b), n in links.items() if r == row[0]} == expected
        for key in expected:
            del links[(row[0], *key)]
    assert not links


def test_edges(spark, sides):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (None, "one two"), (3, ""), (4, "word, " * 30_000), (5, "a▁b")]
    docs = spark.createDataFrame([(i, t, 7, "z", 0) for i, t in rows], "doc_id int, text string, a int, groups string, row int").repartition(3)
    got = alignment.align_tokenizers(docs).collect()
    expected = [(i, *f) for (i, _), f in zip(rows, plain_corpus(sides, [t for _, t in rows]))]
    assert sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got), key=str) == sorted(expected, key=str)
    assert alignment.align_tokenizers(docs.where("false")).isEmpty()


def test_a_pair_that_most_documents_hold(spark, sides):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the").otherwise(F.concat(F.lit("the word "), F.col("id").cast("string"))).alias("text"))
    got = {r["doc_id"]: r for r in alignment.align_tokenizers(docs).collect()}
    (a,), (b,) = (s.own.encode([b" the"])[0] for s in sides)
    assert got[1]["groups"] == f"{a}|{b}" and all(got[i]["count_sum"] == 6000 and got[i]["n_best"] == 1 for i in (1, 2, 4, 5))
    assert len(got) == 6000 and got[3]["count_sum"] > 6000


def test_query_against_plain_counts(spark, sf_dir, sides):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in q.QUERIES["op11_tokenizer_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, expected in zip(docs, plain_corpus(sides, [r["text"] for r in docs])):
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS[:-1]) == expected[:-1]
        assert got[r["doc_id"]]["groups_sha256"] == (hashlib.sha256(expected[-1].encode()).hexdigest() if expected[-1] else "")
