"""Byte-level BPE against the public library, its parts against plain versions, and round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import bpe, pieces
from voxelmill.llm import queries as q
from voxelmill.llm.tokens import PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(q.MULTI_BPE)


@pytest.fixture(scope="module")
def own(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=5):
    rng = random.Random(seed)
    letters = " \n\t '’srtevldmLl1٣é中.!_　\x85\x1c\xa0😀ab"
    return ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_verified(own, ranks):
    entries = list(ranks)
    assert sorted(own.hash.key.tolist()) == list(range(len(entries)))
    asked = entries[::7] + [e + b"\xff~" for e in entries[::7]]
    ends = np.cumsum([len(e) for e in asked])
    starts, data = ends - [len(e) for e in asked], np.frombuffer(b"".join(asked), np.uint8)
    found = own.hash.find(data, starts, ends, pieces.piece_hashes(data, starts, ends))
    assert [entries[i] if i >= 0 else None for i in found] == [e if e in ranks else None for e in asked]


def test_heap_against_plain_merging(own, ranks):
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(2000):
        piece = bytes(rng.choices(b"aeinrst th\xc3\xa9", k=rng.randrange(1, 40)))
        assert bpe.heap_merge([own.byte_ids[b] for b in piece], own.pairs) == plain(piece)


def test_every_code_point_is_cut_as_the_library_cuts_it(own, library):
    texts = [f"a{c}1{c}!{c} {c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)])]
    assert bpe.encode_column(pa.array(texts), own).to_pylist() == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_random_texts_in_parts_of_any_size(own, library, most, monkeypatch):
    texts = random_texts(3000) + [None, "", "a" * 3000, " " * 3000 + "x", "don't we'll I'd THEY'RE 's 'ré '' 's's" * 20, "<|endoftext|>"]
    monkeypatch.setattr(pieces.batches, "__defaults__", (most,))
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts, "y"])[1:-1]):
        ids = bpe.encode_column(column, own)
        assert ids.to_pylist() == [library.encode_ordinary(t or "") for t in texts]
        assert bpe.decode_column(ids, own).to_pylist() == [(t or "").encode() for t in texts]


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"abcabdab", np.uint8)
    starts, ends = np.array([0, 3, 6]), np.array([3, 6, 8])
    which, of = pieces.distinct_pieces(data, starts, ends, np.zeros(3, np.uint64))
    assert [bytes(data[starts[i] : ends[i]]) for i in which[of]] == [b"abc", b"abd", b"ab"]


def test_pieces_are_remembered_and_forgotten():
    rng, asked = random.Random(4), []

    def encode(pieces_):
        asked.extend(pieces_)
        return [list(p) for p in pieces_]

    known = pieces.Remembered(encode, most=200)
    for round_ in range(60):
        words = [bytes(rng.choices(b"abcd", k=rng.randrange(1, 6))) for _ in range(rng.randrange(150))]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts, data = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
        hashes = pieces.piece_hashes(data, starts, ends)
        if round_ % 7 == 6:
            hashes &= np.uint64(15)  # many pieces share a hash
        _, of, ids, n = known.ids_of(data, starts, ends, hashes)
        first = np.cumsum(n) - n
        assert [bytes(ids[first[i] : first[i] + n[i]].tolist()) for i in of] == words
        assert known.start.n <= 200 + 150
    assert len(asked) < 60 * 75


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = q.QUERIES["op13_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges(spark, library):
    long = "Una palabra más. " * 100_000 + "z" * 200_000 + "中文字" * 100_000
    rows = [(1, "one two", "a", 1), (1, "one two", "a", 1), (2, None, "b", None), (None, "", None, 3), (3, long, "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, decoded int")
    out = bpe.decode(bpe.encode(docs, q.MULTI_BPE), q.MULTI_BPE)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["ids"] == (library.encode_ordinary(r["text"] or "") if r["text"] != long else r["ids"])
    assert bpe.encode(docs.where("false"), q.MULTI_BPE).isEmpty()
    few = spark.createDataFrame([([], 1), (None, 2)], "ids array<int>, n int")
    assert [(r["n"], r["decoded"] and bytes(r["decoded"])) for r in bpe.decode(few, q.MULTI_BPE).orderBy("n").collect()] == [(1, b""), (2, None)]
    with pytest.raises(Exception, match="id 99999999 is not in the vocabulary"):
        bpe.decode(few.select(F.array(F.lit(99_999_999)).alias("ids")), q.MULTI_BPE).collect()
