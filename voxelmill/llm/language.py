"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of letter n-grams
(n = 1, 2, 3) that occur in both, divided by the root of the product of both texts' numbers of
n-grams.  A Nystroem map over landmark texts turns it into a finite feature space in which
one-versus-rest kernel ridge regression is solved.  Scoring a batch is two matrix products:
presence @ landmarks, then kernel @ coefficients.

Defined results: null text, empty text and text without letters give ``und`` with score 0; a text
with letters always gets a learned language; ties go to the first language by code point; without a
single labelled text every row gives ``und``.  Repeated rows are scored alike, extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lowest_per_group, small_batches, texts

LETTERS = 128
TRIGRAMS = LETTERS**3
BIGRAMS = LETTERS**2
CODES = TRIGRAMS + BIGRAMS + LETTERS
UNKNOWN = "und"

_classes: np.ndarray | None = None


def letter_classes() -> np.ndarray:
    """For each code point its class: 0 for what is no letter, 1-26 for a-z, 27-127 for the others."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():
                out[i] = i - 96 if 97 <= i <= 122 else 27 + (i * 2654435761 >> 12) % 101
        _classes = out
    return _classes


def ngram_codes(text: str) -> np.ndarray:
    """Codes of the text's letter n-grams, with repeats; each run of other characters counts as one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = letter_classes()[points].astype(np.int32)
    if not ids.any():
        return np.empty(0, np.int32)
    ids = np.concatenate(([0], ids, [0])).astype(np.int32)
    ids = ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]
    tri = (ids[:-2] * LETTERS + ids[1:-1]) * LETTERS + ids[2:]
    bi = TRIGRAMS + ids[:-1] * LETTERS + ids[1:]
    uni = TRIGRAMS + BIGRAMS + ids[ids != 0]
    return np.concatenate((tri, bi, uni))


@dataclass(frozen=True)
class LanguageModel:
    """vocab: n-gram codes of the landmarks; landmarks: their presence, packed bits; norms: their
    numbers of n-grams; coef: one column of coefficients per language."""

    languages: list[str]
    vocab: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    coef: np.ndarray

    def matrix(self) -> np.ndarray:
        """Landmark presence, scaled by norm: one column per landmark."""
        bits = np.unpackbits(self.landmarks, axis=1)[:, : len(self.vocab)]
        return np.ascontiguousarray((bits / np.sqrt(self.norms)[:, None]).astype(np.float32).T)


def _fit_matrix(sets: list[np.ndarray], langs: list[str], landmarks: int, ridge: float) -> LanguageModel | None:
    names = sorted(set(langs))
    if not names:
        return None
    labels = np.array([names.index(x) for x in langs])
    chosen: list[int] = []
    for k in range(len(names)):  # the first ones of each language; rows come in a hashed order
        chosen += np.flatnonzero(labels == k)[: max(1, landmarks // len(names))].tolist()
    vocab = np.unique(np.concatenate([sets[i] for i in chosen])).astype(np.int32)
    norms = np.array([max(1, len(s)) for s in sets], np.float64)
    present = np.zeros((len(sets), len(vocab)), np.float32)
    for i, s in enumerate(sets):
        present[i, np.searchsorted(vocab, s[np.isin(s, vocab, assume_unique=True)])] = 1
    marks = present[chosen]
    knm = (present @ marks.T) / np.sqrt(norms[:, None] * norms[chosen][None, :])
    kmm = knm[chosen]
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-6 * np.eye(len(chosen)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = knm @ root
    onehot = np.where(labels[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weight = (1 / np.bincount(labels))[labels] * len(sets) / len(names)
    gram = (phi * weight[:, None]).T @ phi + ridge * np.eye(len(chosen))
    coef = root @ np.linalg.solve(gram, (phi * weight[:, None]).T @ onehot)
    return LanguageModel(names, vocab, np.packbits(marks.astype(np.uint8), axis=1), norms[chosen], coef.astype(np.float32))


def fit_language_model(docs: DataFrame, trainable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250, max_texts: int = 128_000, landmarks: int = 120, ridge: float = 0.05) -> LanguageModel | None:
    """Fit on at most ``per_language`` whole texts of each language, and fewer of each where so many languages would make
    more than ``max_texts`` (the bounds; every language has one at least): those with the least hash of their id, texts
    that repeat an id and language once.  Only rows with ``trainable`` and a non-null language count."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.where(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    own = own.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("t"))
    per = max(1, min(per_language, max_texts // max(1, own.select("lang").distinct().count())))
    ids = lowest_per_group(own.select("id", "lang", "t", F.xxhash64("id").alias("h")), "lang", ["h", "id", "t"], per).select("id", "lang", "t").distinct()
    # at most per_language rows for each language, and max_texts or one of each language: a proven bound for the broadcast
    picked = own.join(F.broadcast(ids), ["id", "lang", "t"], "left_semi").dropDuplicates(["id", "lang", "t"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(ngram_codes(t)) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("lang"), pa.array(found, pa.list_(pa.int32()))], ["id", "lang", "codes"])

    rows = picked.mapInArrow(sets, "id string, lang string, codes array<int>").withColumn("h", F.xxhash64("id")).collect()
    rows = sorted((r for r in rows if r["codes"]), key=lambda r: (r["h"], r["id"]))
    return _fit_matrix([np.array(r["codes"], np.int32) for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def score_texts(model: LanguageModel, items: list[str], matrix: np.ndarray, mark: np.ndarray) -> list[tuple[str, float]]:
    """Language and score of each text; ``mark`` is an all-false scratch array of CODES booleans."""
    present = np.zeros((len(items), len(model.vocab)), np.float32)
    norms = np.zeros(len(items))
    for i, text in enumerate(items):
        codes = ngram_codes(text)
        if len(codes):
            mark[codes] = True
            norms[i] = np.count_nonzero(mark)
            present[i] = mark[model.vocab]
            mark[codes] = False
    kernel = (present @ matrix) / np.sqrt(np.maximum(norms, 1))[:, None].astype(np.float32)
    out = kernel @ model.coef
    best = out.argmax(axis=1)
    return [(model.languages[k], float(min(1.0, max(0.0, (out[i, k] + 1) / 2)))) if norms[i] else (UNKNOWN, 0.0) for i, k in enumerate(best)]


def identify_language(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, the ``keep`` columns, ``lang_pred`` and ``score`` (0 to 1)."""
    small_batches(docs.sparkSession)
    cols = [id_col, *keep]
    kept = docs.select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = model.matrix() if model else None
        mark = np.zeros(CODES, bool)
        for b in batches:
            found: list[tuple[str, float]] = []
            column = b.column("_text")
            for at in range(0, b.num_rows, 64):
                items = list(texts(column.slice(at, 64)))
                found += score_texts(model, items, matrix, mark) if model else [(UNKNOWN, 0.0)] * len(items)
            own = [b.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*cols, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
