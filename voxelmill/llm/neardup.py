"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets are one class, joined through its smallest id.
Each class has MinHash values at POSITIONS positions.  A tree branches a class by the values at the
positions that a node's hash chooses, one always and a second with probability 1 / similarity - 1, so
that two sets that are similar enough meet in one child of each node on average.  TREES independent
trees repeat this.

* A node of up to NODE classes goes to one task, as MinHash values of one byte each.  The task compares
  all pairs of the node and proposes a spanning forest of the pairs that agree best; those are confirmed
  on full sets of shingle hashes (64 bit) and give the first components.
* Where more pairs of a node agree, its classes meet again, now with their full sets, and all agreeing pairs of
  two components are held against the threshold in the task, so that a proposal that failed loses no other
  link; only a spanning forest of the links found leaves the task.  Nodes of very long texts, whose sets are too
  large for one task, give their agreeing pairs instead, which are confirmed as pairs.
* A node of more classes never goes to one task.  All its classes are compared with its center, the class nearest
  to the most common values of a sample of the node; then the classes outside the center's component
  are copied to each block of the node and compared with it, or the node branches if they are many.

Recall: a pair at the threshold of 0.8 shares a first node with probability 1 - 0.16^8 (a loss of 4e-7); deeper
levels, which only nodes over the limits reach, lose more, 0.02 % at three levels.  Pairs of which fewer than
``agreement`` of the values agree are not confirmed: by default (57 at 0.8) a pair at the threshold falls below with
probability 2e-6; with 1 all pairs of a node are confirmed on full sets, as those agree in the value that branched.

Defined results: null and empty texts have empty sets and no links; with fewer words than a shingle
the whole sequence is the only element; a document with a null id is kept and linked with nothing;
rows that repeat an id are one document, that with the greatest set; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..tables import Scratch
from .shared import lowest_per_group, small_batches, stored

POSITIONS = 96
TREES = 8
#: Classes of a node that one task compares; others of a larger node that are compared with all of it.
NODE, OUTSIDE = 4096, 1024
#: Shingles of the sets that a task holds of one node; levels of branching.
SHINGLES, DEPTH = 4_000_000, 8
#: Pairs per class from which intersections are counted by matrix products, and cells of one such matrix.
DENSE, CELLS = 8, 8_000_000
#: Classes of a node that its most common values are taken from.
SAMPLE = 256
#: Copies of a center's set that its members are dealt to.
SALT = 64
CACHE = 400_000

_MIX = tuple(np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: bytes, words: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``k`` words; ASCII letters count without case."""
    own = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(own) if len(own) < k else k, np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * _MIX[j % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash_params(positions: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(97)
    return (r.integers(1, 2**63, positions, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), r.integers(0, 2**63, positions, dtype=np.uint64)


def minhash(values: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.full(len(params[0]), 2**32 - 1, np.uint32)
    for at in range(0, len(values), 2048):  # bounded memory for any text
        v = values[at : at + 2048]
        mixed = v[None, :] * params[0][:, None] + params[1][:, None]
        mixed ^= mixed >> np.uint64(31)
        out = np.minimum(out, ((mixed * params[0][:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def tree_positions(similarity: float) -> list[tuple[int, int]]:
    """(tree, position) of the first branches: one position of each tree, of some trees two; none twice."""
    r = np.random.default_rng(41)
    order = iter(r.permutation(POSITIONS).tolist())
    return [(t, next(order)) for t in range(TREES) for _ in range(1 + (t < round(TREES * (1 / similarity - 1))))]


def least_agreement(percent: int) -> int:
    """Of POSITIONS values so many agree at least, but for five standard deviations, at the threshold."""
    j = percent / 100
    return int(POSITIONS * j - 5 * (POSITIONS * j * (1 - j)) ** 0.5)


def signatures(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """``docs``: id, text.  Per row: id, n_shingles, key1 and key2 (two hashes of the set), brief (a byte of each
    MinHash value) and nodes (of the trees' first level); the last two are null for an empty set."""
    schema = f"id {dict(docs.dtypes)['id']}, n_shingles bigint, key1 bigint, key2 bigint, brief binary, nodes array<bigint>"
    branches = tree_positions(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, params = WordHashes(), minhash_params(POSITIONS)
        trees, places = (np.array(x, np.uint64) for x in zip(*branches, strict=True))
        for b in batches:
            n, key1, key2, brief, nodes = [], [], [], [], []
            for x in b.column("text").cast(pa.binary()):
                s = shingle_set(x.as_py() or b"", words, k)
                raw = s.tobytes()
                n.append(len(s))
                key1.append(xxhash.xxh3_64_intdigest(raw, 1) - 2**63)
                key2.append(xxhash.xxh3_64_intdigest(raw, 2) - 2**63)
                if len(s):
                    sig = minhash(s, params)
                    brief.append(sig.astype(np.uint8).tobytes())
                    h = (sig[places].astype(np.uint64) ^ (trees << np.uint64(40)) ^ (places << np.uint64(50))) * _MIX[0]
                    nodes.append((h ^ (h >> np.uint64(31))).view(np.int64).tolist())
                else:
                    brief.append(None)
                    nodes.append(None)
            arrays = [b.column("id"), pa.array(n, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(brief, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "key1", "key2", "brief", "nodes"])

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs``: id, text.  Per row: id, key1 (as in signatures), items (sorted shingle hashes, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingle_set(x.as_py() or b"", words, k).tobytes() for x in b.column("text").cast(pa.binary())]
            keys = [xxhash.xxh3_64_intdigest(x, 1) - 2**63 for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["id", "key1", "items"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, key1 bigint, items binary")


def agreements(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many values agree, for each row of ``sig`` and each of ``other``."""
    if len(sig) * len(other) < 2048:
        return (sig[:, None, :] == other[None, :, :]).sum(axis=2, dtype=np.uint8)
    out = np.zeros((len(sig), len(other)), np.uint8)
    columns = np.ascontiguousarray(other.T)
    for at in range(0, len(sig), 256):  # a block stays in the processor's cache
        part = np.ascontiguousarray(sig[at : at + 256].T)
        for p in range(POSITIONS):
            out[at : at + 256] += part[p][:, None] == columns[p][None, :]
    return out


class Node:
    """Classes of one node: sig (a row of bytes each), size (of their sets), tie (a hash of their ids)."""

    def __init__(self, sig: np.ndarray, size: np.ndarray, tie: np.ndarray, low: int, percent: int):
        self.sig, self.size, self.tie, self.low, self.percent = sig, size, tie, low, percent

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agreement of pairs that may reach the threshold, 0 of others."""
        out = agreements(self.sig[a], self.sig[b])
        x, y = self.size[a][:, None], self.size[b][None, :]
        out[(out < self.low) | (100 * np.minimum(x, y) < self.percent * np.maximum(x, y))] = 0
        return out

    def forest(self) -> tuple[list[tuple[int, int]], bool]:
        """A spanning forest of the likely pairs, the best agreeing first; and whether there are more pairs."""
        n = len(self.sig)
        every = np.arange(n)
        agree = self.likely(every, every)
        np.fill_diagonal(agree, 0)
        total = np.count_nonzero(agree) // 2
        if not total:
            return [], False
        linked = np.flatnonzero(agree.any(axis=1))
        if len(linked) < n:
            agree = agree[np.ix_(linked, linked)]
        tie, n, edges = self.tie[linked], len(linked), []
        # Prim's algorithm; equal agreements by a hash of the pair, so that nodes choose alike
        best, source, outside = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
        at = 0
        for _ in range(n):
            outside[at] = False
            weight = (agree[at].astype(np.uint64) << np.uint64(32)) | (((tie + tie[at]) * _MIX[1]) >> np.uint64(32))
            better = outside & (agree[at] > 0) & (weight > best)
            best[better], source[better] = weight[better], at
            at = int(np.argmax(np.where(outside, best, 0)))
            if not outside[at] or not best[at]:
                rest = np.flatnonzero(outside)
                if not len(rest):
                    break
                at = int(rest[0])
            else:
                edges.append((int(linked[source[at]]), int(linked[at])))
        return edges, total > len(edges)

    def across(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likely pairs of different parts, the best agreeing first, and their agreement."""
        every = np.arange(len(self.sig))
        agree = self.likely(every, every)
        agree[part[:, None] == part[None, :]] = 0
        a, b = np.nonzero(np.triu(agree, 1))
        near = agree[a, b]
        order = np.argsort(-near.astype(np.int16), kind="stable")
        return a[order], b[order], near[order]


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * common >= percent * union, for sorted sets."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(p) + len(q) - common)


def commons(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``others``, by matrix products."""
    columns = np.unique(np.concatenate([sets[i] for i in rows]))
    out = np.zeros((len(rows), len(others)), np.float32)

    def places(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate([sets[i] for i in which]), np.repeat(np.arange(len(which)), [len(sets[i]) for i in which])
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        own = columns[at] == flat
        return row[own], at[own]

    left, right = places(rows), places(others)
    step = max(64, CELLS // max(len(rows), len(others)))
    for c in range(0, len(columns), step):
        parts = []
        for (row, at), n in ((left, len(rows)), (right, len(others))):
            own = (at >= c) & (at < c + step)
            x = np.zeros((n, min(step, len(columns) - c)), np.float32)
            x[row[own], at[own] - c] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def links_across(sets: list[np.ndarray], part: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (a, b) those that are similar and join parts that no pair before has joined."""
    name = np.unique(part, return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        out.append((i, j))
        name[name == name[j]] = name[i]

    if len(a) <= DENSE * len(part):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if name[i] != name[j] and similar(sets[i], sets[j], percent):
                join(i, j)
        return out
    size = np.array([len(s) for s in sets], np.float32)
    wanted = np.zeros((len(part), len(part)), bool)
    wanted[a, b] = wanted[b, a] = True
    rows = np.flatnonzero(wanted.any(axis=1))
    for at in range(0, len(rows), 256):
        block = rows[at : at + 256]
        others = rows[at:]
        common = commons(sets, block, others)
        linked = wanted[np.ix_(block, others)] & (100 * common >= percent * (size[block][:, None] + size[others][None, :] - common))
        for i, own in zip(block.tolist(), linked, strict=True):
            while len(more := others[own & (name[others] != name[i])]):
                join(i, int(more[0]))
    return out


def _in_nodes(members: DataFrame, percent: int, low: int) -> DataFrame:
    """``members``: node, id, n_shingles, brief; with part (a hash of the component) pairs of different parts only; with
    items (the full sets) confirmed ones.  Pairs (a, b) of each node, and more: whether the node has likely
    pairs besides these."""
    kind = dict(members.dtypes)["id"]
    again, exact = "part" in members.columns, "items" in members.columns
    cols = ["id", "n_shingles", "tie", "brief", *["part"] * again, *["items"] * exact]
    grouped = members.withColumn("tie", F.xxhash64("id")).groupBy("node").agg(F.collect_list(F.struct(*cols)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("m")
            flat, ends = m.flatten(), np.append(0, np.cumsum(m.value_lengths().to_numpy()))
            if not len(flat):
                continue
            ids, sig = flat.field("id"), np.frombuffer(b"".join(flat.field("brief").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            size, tie = flat.field("n_shingles").to_numpy(), flat.field("tie").to_numpy().view(np.uint64)
            part = flat.field("part").to_numpy() if again else None
            first, second, nodes, more = [], [], [], []
            starts, sizes = ends[:-1], np.diff(ends)
            plain = sizes > 1
            pairs = np.flatnonzero(sizes == 2)  # most nodes: all at once
            if len(pairs) and not exact:
                x, y = starts[pairs], starts[pairs] + 1
                fit = ((sig[x] == sig[y]).sum(axis=1) >= low) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
                if again:
                    fit &= part[x] != part[y]
                first, second, nodes = x[fit].tolist(), y[fit].tolist(), pairs[fit].tolist()
                more = [False] * len(nodes)
                plain[pairs] = False
            for k in np.flatnonzero(plain):
                s, rest = slice(ends[k], ends[k + 1]), False
                node = Node(sig[s], size[s], tie[s], low, percent)
                if again:
                    i, j, _ = node.across(part[s])
                    if exact and len(i):
                        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in flat.field("items")[s]]
                        found = links_across(sets, part[s], i, j, percent)
                    else:
                        found = zip(i.tolist(), j.tolist(), strict=True)
                else:
                    found, rest = node.forest()
                for i, j in found:
                    first.append(ends[k] + i)
                    second.append(ends[k] + j)
                    nodes.append(k)
                    more.append(rest)
            take = lambda x: ids.take(pa.array(np.array(x, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(np.array(nodes, np.int64))), take(first), take(second), pa.array(more, pa.bool_())], ["node", "a", "b", "more"])

    return grouped.mapInArrow(run, f"node bigint, a {kind}, b {kind}, more boolean")


def _agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """Adds agree to pairs with the columns brief and other (bytes of two classes)."""
    fields = [f"`{c}` {t}" for c, t in pairs.dtypes if c not in ("brief", "other")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("brief", "other"))
            kept = b.drop_columns(["brief", "other"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((x == y).sum(axis=1).astype(np.int32))], [*kept.schema.names, "agree"])

    return pairs.mapInArrow(run, ", ".join([*fields, "agree int"]))


class Search:
    """One search for links: ``reps`` are the classes (id, n_shingles, key1, brief, nodes), ``docs`` has the texts."""

    def __init__(self, reps: DataFrame, docs: DataFrame, k: int, percent: int, low: int, scratch: Scratch):
        self.reps, self.docs, self.k, self.percent, self.scratch = reps, docs, k, percent, scratch
        self.spark, self.kind = reps.sparkSession, dict(reps.dtypes)["id"]
        self.low = low
        self.sets: list[DataFrame] = []
        self.parts = self.spark.createDataFrame([], f"id {self.kind}, component {self.kind}")

    def fit(self, x: str, y: str):
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def briefs(self, name: str, brief: str, size: str) -> DataFrame:
        return self.reps.select(F.col("id").alias(name), F.col("brief").alias(brief), F.col("n_shingles").alias(size))

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """The full sets of all ids at least; a text is read and cut once in the search."""
        for known in self.sets:
            ids = ids.join(known.select("id"), "id", "left_anti")
        ids = self.scratch.stored(ids, "dedup-ids")
        if not ids.isEmpty():
            sets = full_sets(self.docs.join(ids, "id", "left_semi"), self.k).join(self.reps.select("id", "key1"), ["id", "key1"], "left_semi")
            self.sets.append(self.scratch.stored(sets.dropDuplicates(["id"]).drop("key1"), "dedup-sets"))
        self.scratch.drop(ids)
        out = self.sets[0] if self.sets else self.spark.createDataFrame([], f"id {self.kind}, items binary")
        for more in self.sets[1:]:
            out = out.unionByName(more)
        return out

    def confirm(self, pairs: DataFrame, star: bool = False) -> None:
        """Adds the pairs (a, b) with 100 * common >= percent * union to the components.  ``star``: b may have very many
        pairs, so its set is copied and the pairs are dealt to the copies."""
        pairs = self.scratch.stored(pairs, "dedup-pairs")
        if pairs.isEmpty():
            return
        sets = self.sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        first, second = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        if star:
            second = second.join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            both = pairs.join(first, "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")).join(second, ["b", "salt"]).select("a", "b", "x", "y")
        else:
            both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        self.join(self.scratch.stored(both.mapInArrow(run, f"a {self.kind}, b {self.kind}"), "dedup-found"))
        self.scratch.drop(pairs)

    def join(self, found: DataFrame) -> None:
        """Adds links (a, b), a table of the search, to the components."""
        before = self.parts
        # what is known already is a forest of stars, so a round or two add the new links
        self.parts = connected_components(before.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found), store=self.scratch.stored)
        self.scratch.drop(found, before)

    def counted(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (node, id) with n, the classes of the node, where these are more than one."""
        rows = rows.distinct()
        counts = self.scratch.stored(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts")
        out = self.scratch.stored(rows.join(counts, "node"), name)
        self.scratch.drop(counts)
        return out

    def with_parts(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.parts, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def again(self, small: DataFrame) -> None:
        """Adds the links between different components within nodes of up to NODE classes: node, id."""
        rows = self.with_parts(small.select("node", "id")).withColumn("part", F.xxhash64("c")).drop("c")
        rows = self.scratch.stored(rows.join(self.reps.select("id", "n_shingles"), "id"), "dedup-again")
        mixed = rows.groupBy("node").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("n_shingles").alias("total")).where("lo != hi")
        mixed = self.scratch.stored(mixed.select("node", (F.col("total") <= SHINGLES).alias("light")), "dedup-mixed")
        held = self.scratch.stored(rows.join(mixed, "node").join(self.reps.select("id", "brief"), "id"), "dedup-held")
        self.scratch.drop(rows, mixed)
        if not held.isEmpty():
            light, heavy = held.where("light").drop("light"), held.where("NOT light").drop("light")
            sets = self.sets_of(light.select("id").distinct())
            found = _in_nodes(light.join(sets, "id"), self.percent, self.low).select("a", "b")
            self.join(self.scratch.stored(found, "dedup-across"))
            self.confirm(_in_nodes(heavy, self.percent, self.low).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        self.scratch.drop(held)

    def centers(self, big: DataFrame) -> DataFrame:
        """Per node: center, the class that agrees best with the most common values of a sample of the node."""
        sample = lowest_per_group(big.select("node", "id", F.xxhash64("id", "node").alias("h")), "node", ["h", "id"], SAMPLE)
        sample = sample.join(self.reps.select("id", "brief"), "id").groupBy("node").agg(F.collect_list("brief").alias("m"))

        def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for m in b.column("m").to_pylist():
                    sig = np.frombuffer(b"".join(m), np.uint8).reshape(-1, POSITIONS)
                    out.append(bytes(int(np.bincount(c, minlength=256).argmax()) for c in sig.T))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], ["node", "other"])

        wanted = self.scratch.stored(sample.mapInArrow(common, "node bigint, other binary"), "dedup-common")
        near = _agreeing(big.select("node", "id").join(self.reps.select("id", "brief"), "id").join(wanted, "node"), self.percent)
        best = near.groupBy("node").agg(F.max(F.struct("agree", F.xxhash64("id").alias("h"), "id")).alias("m"))
        out = self.scratch.stored(best.select("node", F.col("m.id").alias("center")), "dedup-centers")
        self.scratch.drop(wanted)
        return out

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that agree enough."""
        both = pairs.join(self.briefs("a", "brief", "na"), "a").join(self.briefs("b", "other", "nb"), "b").where(self.fit("na", "nb"))
        return _agreeing(both.select("a", "b", "brief", "other"), self.percent).where(F.col("agree") >= self.low).select("a", "b")

    def outside(self, rows: DataFrame) -> DataFrame:
        """``rows``: node, id, n, c, main, others (how many have c != main).  Nodes of NODE classes at most that hold each
        pair of one of the others and one of all: groups of the others are copied to blocks of the node."""
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        dealt = lambda n: F.pmod(F.xxhash64("id"), n)
        rows = rows.withColumn("blocks", F.ceil(F.col("n") / (NODE - 2 * OUTSIDE))).withColumn("groups", F.ceil(F.col("others") / OUTSIDE))
        few = rows.where("c != main").withColumn("group", dealt(F.col("groups"))).withColumn("block", every(F.col("blocks")))
        many = rows.withColumn("block", dealt(F.col("blocks"))).withColumn("group", every(F.col("groups")))
        cols = [F.xxhash64("node", "block", "group").alias("node"), "id"]
        return few.select(*cols).unionByName(many.select(*cols)).distinct()

    def branched(self, rows: DataFrame) -> DataFrame:
        """``rows``: node, id.  Their child nodes."""
        at = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(POSITIONS)).cast("int")
        often = (F.pmod(F.xxhash64("node", F.lit(3)), F.lit(10_000)) < int(10_000 * (100 / self.percent - 1))) & (at(1) != at(2))
        child = lambda p: F.xxhash64("node", p, F.substring(F.col("brief"), p + 1, F.lit(1)))
        children = F.when(often, F.array(child(at(1)), child(at(2)))).otherwise(F.array(child(at(1))))
        return rows.select("node", "id").join(self.reps.select("id", "brief"), "id").select("id", F.explode(children).alias("node"))

    def large(self, big: DataFrame) -> None:
        """Nodes of more than NODE classes: node, id, n."""
        for depth in range(DEPTH):
            if big.isEmpty():
                return
            centers = self.centers(big)
            star = big.join(centers, "node").where("id != center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
            self.confirm(self.likely(star), star=True)
            main = self.with_parts(centers.withColumnRenamed("center", "id")).select("node", F.col("c").alias("main"))
            rows = self.scratch.stored(self.with_parts(big).join(main, "node"), "dedup-big")
            out = rows.groupBy("node").agg(F.sum((F.col("c") != F.col("main")).cast("int")).alias("others")).where("others > 0")
            out = self.scratch.stored(out, "dedup-others")
            few = F.lit(depth == DEPTH - 1) | (F.col("others") <= OUTSIDE)
            self.again(self.outside(rows.join(out.where(few), "node")))
            below = self.counted(self.branched(rows.join(out.where(~few).select("node"), "node", "left_semi")), "dedup-below")
            self.again(below.where(F.col("n") <= NODE))
            big = self.scratch.stored(below.where(F.col("n") > NODE), "dedup-large")
            self.scratch.drop(rows, out, below, centers)

    def components(self) -> DataFrame:
        """id and component of the classes that are linked, without the smallest ids themselves."""
        held = self.counted(self.reps.select("id", F.explode("nodes").alias("node")), "dedup-nodes")
        small = held.where(F.col("n") <= NODE)
        found = _in_nodes(small.select("node", "id").join(self.reps.select("id", "n_shingles", "brief"), "id"), self.percent, self.low)
        found = self.scratch.stored(found, "dedup-forest")
        self.confirm(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        # only classes of the forest have likely pairs
        self.again(found.where("more").select("node", F.explode(F.array("a", "b")).alias("id")).distinct())
        self.large(self.scratch.stored(held.where(F.col("n") > NODE), "dedup-large"))
        return self.parts


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, agreement: int | None = None) -> DataFrame:
    """Per document: its id, n_shingles, class_id (smallest id with the same set), component_id (smallest id
    reachable by links of ``percent`` similarity) and kept (it is that smallest id).  ``agreement``: the MinHash values,
    of POSITIONS, that a pair of a node must share to be confirmed; 1 confirms all of them."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(spark)
    with Scratch(spark) as scratch:
        signed = scratch.stored(signatures(own, shingle, percent / 100), "dedup-signatures")
        known = signed.where(F.col("id").isNotNull())
        one = known.groupBy("id").agg(F.max(F.struct("n_shingles", "key1", "key2", "brief", "nodes")).alias("m")).select("id", "m.*")
        one = scratch.stored(one, "dedup-one")
        classes = one.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("id", "brief", "nodes")).alias("m"))
        reps = scratch.stored(classes.select("key1", "key2", "n_shingles", "m.id", "m.brief", "m.nodes"), "dedup-classes")
        parts = Search(reps, own, shingle, percent, agreement or least_agreement(percent), scratch).components()
        names = reps.join(parts, "id", "left").select("key1", "key2", "n_shingles", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
        out = one.select("id", "n_shingles", "key1", "key2").join(names, ["key1", "key2", "n_shingles"], "left")
        out = out.select("id", "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
        unknown = signed.where(F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
        out = out.unionByName(unknown)
        return stored(out.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "dedup-result")


def oracle_sql(shingle: int = 4, percent: int = 80, id_col: str = "doc_id", table: str = "documents") -> str:
    """The result by brute force over all pairs that share a shingle."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(shingle))
    return f"""
WITH RECURSIVE d AS (
  SELECT {id_col} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
s AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: {grams})) END AS g FROM d),
e AS (SELECT id, unnest(g) AS x FROM s),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE 100 * n >= {percent} * (len(p.g) + len(q.g) - n)),
reach(a, b) AS (SELECT id, id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT id AS {id_col}, CAST(len(g) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM s JOIN c USING (id)"""
