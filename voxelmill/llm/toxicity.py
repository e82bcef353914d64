"""Toxicity with a counterfactually regularised linear classifier.

Features are the presence of words and of word beginnings.  Where a sentence of the labelled texts
names a group of people, the name is swapped for those of other groups, and the squared change of the
score is part of the loss: the classifier can't lean on the mention of a group.  Corpora may name groups
rarely, so every second labelled text also serves with a name placed at a hashed word of it, under
its own label; these mentions are swapped like any others.

Defined results: null and empty texts hold no feature and get the score of the intercept; without
labelled rows (or with a single class) every score is the class prior (0 without rows).  Repeated
rows are scored alike, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import Scratch, small_batches, texts

# Names of groups of people, by kind; a name is swapped for others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)

LETTER_RUN = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
PREFIXES = (4, 5, 6)
#: Features whose counts a task holds at once; it bounds memory only.
HELD = 200_000
#: A row's part of loss and slope is a whole number of 1 / UNIT.
UNIT = 2.0**30

_swaps = {term: [x for x in row if x != term] for row in IDENTITY_TERMS for term in row}


def features(text: str) -> tuple[set[str], set[str]]:
    """The words of a text, and the beginnings of those longer than these."""
    words = set(LETTER_RUN.findall(text.lower()))
    return words, {w[:k] for w in words for k in PREFIXES if len(w) > k}


def named(words: set[str], starts: set[str]) -> list[str]:
    return [*words, *("^" + s for s in starts)]


def with_mention(text: str) -> str:
    """The text with a name of a group at one of its words, both by a hash of the text."""
    h = xxhash.xxh3_64_intdigest(text.encode())
    gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
    at, names = gaps[h % len(gaps)], sorted(_swaps)
    return f"{text[:at]} {names[(h >> 32) % len(names)]}{text[at:]}"


def counterfactuals(text: str) -> list[tuple[list[str], list[str]]]:
    """For each sentence that names a group and each other name of its kind: the features that a swap
    adds and removes."""
    low = text.lower()
    if not any(t in low for t in _swaps):
        return []
    out = []
    for sentence in SENTENCE_END.split(low):
        words = set(LETTER_RUN.findall(sentence))
        for term in sorted(words & _swaps.keys()):
            before = set(named(*features(sentence)))
            for other in _swaps[term]:
                after = set(named(*features(re.sub(rf"(?<![^\W\d_]){term}(?![^\W\d_])", other, sentence))))
                out.append((sorted(after - before), sorted(before - after)))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    #: Kinds of swaps that its loss held.
    n_swaps: int = 0

    def score(self, text: str) -> float:
        words, starts = features(text)
        z = self.bias
        for found, weights in ((words, self.words), (starts, self.starts)):
            for x in sorted(found & weights.keys()):  # a fixed order: the sum doesn't depend on hashing
                z += weights[x]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], curvature: np.ndarray, steps: int, *, memory: int = 10, least: float = 1e-6) -> np.ndarray:
    """L-BFGS with halved steps: ``loss`` gives value and slope at a point and is asked ``steps`` times at most.
    ``curvature``: about how much each weight's slope changes with it, in whose units the steps are."""
    unit = curvature**-0.5

    def ask(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = loss(unit * w)
        return value, unit * slope

    w = np.zeros(len(unit))
    value, slope = ask(w)
    asked, moves = 1, []
    while asked < steps and np.linalg.norm(slope) > least:
        way, shares = -slope, []
        for s, t in reversed(moves):
            shares.append(s @ way / (s @ t))
            way = way - shares[-1] * t
        if moves:
            s, t = moves[-1]
            way = way * (s @ t) / (t @ t)
        for (s, t), share in zip(moves, reversed(shares), strict=True):
            way = way + (share - t @ way / (s @ t)) * s
        rate = 1.0
        while asked < steps:
            new = w + rate * way
            new_value, new_slope = ask(new)
            asked += 1
            if new_value <= value + 1e-4 * rate * (way @ slope):
                break
            rate /= 2
        else:
            break
        if (new - w) @ (new_slope - slope) > 1e-12 * np.linalg.norm(new_slope - slope) ** 2:
            moves = [*moves[1 - memory :], (new - w, new_slope - slope)]
        w, value, slope = new, new_value, new_slope
    return unit * w


def penalised(w: np.ndarray, value: float, slope: np.ndarray, pairs: np.ndarray, l2: float, swap_penalty: float) -> tuple[float, np.ndarray]:
    """A mean logistic loss and its slope, with l2 and swap penalty added.  ``pairs``: a row of feature changes for each
    swap, scaled by the root of its share of all swaps.  The last weight is the intercept, which is free."""
    own, change = w[:-1], pairs @ w[:-1]
    return value + l2 / 2 * own @ own + swap_penalty * change @ change, slope + np.append(l2 * own + 2 * swap_penalty * (pairs.T @ change), 0)


def curvature(share: np.ndarray, pairs: np.ndarray, l2: float, swap_penalty: float) -> np.ndarray:
    """The most that each weight's slope changes with it, where ``share`` of the rows have its feature."""
    return share / 4 + l2 + np.append(2 * swap_penalty * (pairs**2).sum(axis=0), 0)


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, *, l2: float, swap_penalty: float, steps: int) -> np.ndarray:
    """The least loss over rows at hand, weighted; ``fit_toxicity`` sums the same loss over a table."""
    x1, weight = np.hstack([x, np.ones((len(x), 1))]).astype(float), weight / weight.sum()

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        each, slope = logistic(x1 @ w, y)
        return penalised(w, float(weight @ each), x1.T @ (weight * slope), pairs, l2, swap_penalty)

    return minimised(loss, curvature(x1.T @ weight, pairs, l2, swap_penalty), steps)


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the loss at ``z`` and its slope."""
    return np.logaddexp(0, z) - y * z, (1 + np.tanh(z / 2)) / 2 - y


def summed_loss(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss and slope at ``w`` over all ``rows`` (y, found: places of features), in one pass.  Each row's
    numbers are rounded to 2 ** -30, so that any split of the rows gives the same sums to the last bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, value, total = 0, 0, np.zeros(len(w), np.int64)
        for b in batches:
            found, y = b.column("found"), b.column("y").to_numpy()
            row, places = np.repeat(np.arange(len(y)), found.value_lengths().to_numpy()), found.flatten().to_numpy()
            each, slope = logistic(np.bincount(row, w[places], len(y)) + w[-1], y)
            whole = np.rint(slope * UNIT)
            total[:-1] += np.bincount(places, whole[row], len(w) - 1).astype(np.int64)  # of a batch's whole numbers: exact
            total[-1] += int(whole.sum())
            n, value = n + len(y), value + int(np.rint(each * UNIT).astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([value], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "value", "total"])

    parts = by_task(rows.select("y", "found"), run, "n bigint, value bigint, total binary")
    n = sum(p["n"] for p in parts) * UNIT
    return sum(p["value"] for p in parts) / n, sum(np.frombuffer(p["total"], np.int64) for p in parts) / n


def feature_counts(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """How many ``rows`` there are, and how many of them hold each of ``width`` features, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for b in batches:
            n, total = n + b.num_rows, total + np.bincount(b.column("found").flatten().to_numpy(), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    parts = by_task(rows.select("found"), run, "n bigint, total binary")
    return sum(p["n"] for p in parts), sum(np.frombuffer(p["total"], np.int64) for p in parts)


def by_task(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> list[Row]:
    """The sums that ``run`` makes of a task's rows.  They have a number for each feature, so there are as many tasks as
    cores, not one for each file."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema).collect()


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_features: int = 1500, min_docs: int = 4, l2: float = 2e-5, swap_penalty: float = 1.0, steps: int = 60) -> ToxicityModel:
    """Fit on all labelled texts: features are counted, swaps gathered and the loss summed over every one, in ``steps``
    passes at most over a table of the features that each holds.  Of texts that share an id the one of the least hash."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel(40.0 if totals.get(1) else -40.0)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(own, "id")
    labelled = labelled.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> Iterator[pa.RecordBatch]:
            for y, own in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array(own.values() if k == y else np.zeros(len(own), np.int64), pa.int64()) for k in (1, 0))], ["f", "p", "q"])
                own.clear()

        for b in batches:
            for y, text in zip(b.column("y").to_pylist(), texts(b.column("text")), strict=True):
                found[y].update(named(*features(text)))
            if len(found[0]) + len(found[1]) > HELD:
                yield from counted()
        yield from counted()

    with Scratch(spark) as scratch:
        labelled = scratch.stored(labelled, "toxicity-labelled")
        n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            return ToxicityModel(40.0 if n.get(1) else -40.0)
        counts = labelled.mapInArrow(count, "f string, p bigint, q bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= min_docs)
        a, b = F.col("p") / n[1], F.col("q") / n[0]
        pooled = (F.col("p") + F.col("q")) / (n[0] + n[1])
        strength = F.abs(a - b) / F.sqrt(pooled * (1 - pooled) + 1e-4)
        names = sorted({f for term in _swaps for f in named(*features(term))})  # the names and their beginnings, always
        vocab = [r["f"] for r in counts.where(~F.col("f").isin(names)).orderBy(strength.desc(), "f").limit(max_features).collect()] + names
        at = {f: i for i, f in enumerate(vocab)}

        def places(found: Iterable[str]) -> list[int]:
            return sorted(at[f] for f in found if f in at)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("added", pa.list_(pa.int32())), ("removed", pa.list_(pa.int32()))]))
            for b in batches:
                labels, found, swaps = [], [], []
                for y, text in zip(b.column("y").to_pylist(), texts(b.column("text")), strict=True):
                    versions = [text, with_mention(text)] if xxhash.xxh3_64_intdigest(text.encode(), 3) % 2 == 0 else [text]
                    for version in versions:
                        labels.append(y)
                        found.append(places(named(*features(version))))
                        swaps.append([{"added": places(a), "removed": places(r)} for a, r in counterfactuals(version)] if version is versions[-1] else [])
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(swaps, kind)], ["y", "found", "swaps"])

        rows = scratch.stored(labelled.mapInArrow(encode, "y int, found array<int>, swaps array<struct<added:array<int>,removed:array<int>>>"), "toxicity-rows")
        # swaps that change the same features are one row: as many as there are names and what beginnings they share
        change = rows.select(F.explode("swaps").alias("s")).select("s.added", "s.removed")
        changes = change.groupBy("added", "removed").agg(F.count("*").alias("n")).orderBy("added", "removed").collect()
        pairs, total = np.zeros((len(changes), len(vocab))), sum(r["n"] for r in changes)
        for i, r in enumerate(changes):
            pairs[i, r["added"]] = (r["n"] / total) ** 0.5
            pairs[i, r["removed"]] = -((r["n"] / total) ** 0.5)
        n_rows, held = feature_counts(rows, len(vocab))
        share = np.append(held, n_rows) / n_rows
        w = minimised(lambda w: penalised(w, *summed_loss(rows, w), pairs, l2, swap_penalty), curvature(share, pairs, l2, swap_penalty), steps)
    weights = {f: float(w[i]) for f, i in at.items()}
    return ToxicityModel(float(w[-1]), {f: v for f, v in weights.items() if f[0] != "^"}, {f[1:]: v for f, v in weights.items() if f[0] == "^"}, len(changes))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns and ``score`` (0 to 1)."""
    small_batches(docs.sparkSession)
    cols = list(keep)
    kept = docs.select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t) for t in texts(b.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(scores, pa.float64())], [*cols, "score"])

    return kept.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < threshold for t in texts(b.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
