"""Benchmark decontamination by latent semantic retrieval.

Texts are cut to overlapping passages of two lengths.  One pass over all documents counts document frequencies
and sketches the products of the word frequencies of all their passages; from it comes a randomised singular
value decomposition of the TF-IDF passages of corpus and benchmark.  Every passage of every document is then
projected and compared by cosine with the benchmark's passages.  An exact bound comes first: an
item of which no region of the text has enough words can't reach the subsequence asked for, and isn't compared.
The least cosine is low, as a paraphrase of a short item has little in common with it: recall of pairs that
a brute-force alignment accepts is aimed at 0.9 and more with 20 to 40 % of the words replaced.  Each candidate is aligned with its item, and the longest common subsequence decides: a high
share is a copy, a middling one counts as a paraphrase only if the item's answer (its last words, or
an answer column) stands there too.

The benchmark is the query set: it is searched in blocks of ``block_items``, each of which is two passes over the
documents, one for its model and one for its pairs.

Defined results: null and empty texts and items match nothing; repeated ids are judged row by row, and
give a pair once; ties need no order, as all pairs that pass are returned; an empty benchmark or table
gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Words of a block; passages are SHORT or LONG blocks.
BLOCK = 4
SHORT, LONG = 3, 8
#: Items of fewer words are looked for with short passages.
LONG_FROM = 32
#: Passages of a text that are compared at once, and counts that are held at once; they bound memory only.
PASSAGES, CELLS = 2048, 2_000_000
#: Passages that are multiplied at once, and rows of a batch of sums.
TOGETHER, ROWS = 32, 4096
#: Tasks for each core that sum over the documents, and tasks that add their sums up.
TASKS, SUMS = 4, 8


EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”‘’«»…–—"


def cut_words(column: pa.Array) -> pa.ListArray:
    """The spellings of each text, between white space; some are empty where white space stands at an end."""
    return pc.utf8_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))


def normalised(spellings: pa.Array) -> pa.Array:
    """In lower case, without the punctuation at the edges."""
    return pc.utf8_trim(pc.utf8_lower(spellings), EDGES)


def words_of(text: str) -> list[str]:
    return [w for w in normalised(cut_words(pa.array([text], pa.string())).flatten()).to_pylist() if w]


class WordIds:
    """Ids of words: their places in a vocabulary, from 1, and 0 for others."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = pa.array(vocabulary, pa.string())
        self.ids = np.append(np.fromiter(vocabulary.values(), np.int32, len(vocabulary)), np.int32(0))

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text's words; a batch's spellings are looked up once each."""
        cut = cut_words(column)
        ends = np.append(0, np.cumsum(cut.value_lengths().to_numpy()))
        spelled = cut.flatten().dictionary_encode()
        if not len(spelled):
            return [np.empty(0, np.int32)] * len(column)
        known = pc.fill_null(pc.index_in(normalised(spelled.dictionary), value_set=self.words), len(self.words)).to_numpy()
        found = np.where(pc.equal(spelled.dictionary, "").to_numpy(zero_copy_only=False), -1, self.ids[known]).astype(np.int32)
        ids = found[spelled.indices.to_numpy()]
        return [r[r >= 0] if len(r) and (r[0] < 0 or r[-1] < 0) else r for r in (ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for x in b:
        m = row & places.get(x, 0)
        row = ((row + m) | (row - m)) & mask
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Item:
    key: str
    words: list[str]
    answer: list[str]

    @property
    def blocks(self) -> int:
        return LONG if len(self.words) >= LONG_FROM else SHORT

    def passages(self) -> list[tuple[int, list[str]]]:
        """(offset, words): every fourth start, and the last one."""
        size = self.blocks * BLOCK
        last = max(0, len(self.words) - size)
        return [(o, self.words[o : o + size]) for o in sorted({*range(0, last + 1, 4), last})]


@dataclass(frozen=True)
class Index:
    """vocabulary: word ids from 1; vectors: one row per id, the projected word and, last, the squared weight of
    a word that the projection leaves out; latent: unit vectors of passages by size in blocks, with
    their items and offsets."""

    items: list[Item]
    vocabulary: dict[str, int]
    vectors: np.ndarray
    latent: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_ids: list[list[int]]
    answer_ids: list[list[int]]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.item_ids])

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    @cached_property
    def flat(self) -> np.ndarray:
        return np.array([w for x in self.item_ids for w in x])

    @cached_property
    def longest(self) -> int:
        return int(self.lengths.max())

    @cached_property
    def item_words(self) -> list[np.ndarray]:
        return [np.unique(x) for x in self.item_ids]

    @cached_property
    def item_counts(self) -> list[np.ndarray]:
        return [np.unique(x, return_counts=True)[1] for x in self.item_ids]


class Sketch:
    """Sums over texts, each the ids of its words (0: no word of the benchmark): documents of each word, its squared
    frequencies, and T'(T signs) for the word frequencies T of the texts' passages of LONG blocks, end to end, the last
    one shorter.  All sums are of integers, so any split of the texts gives the same ones to the last bit."""

    def __init__(self, signs: np.ndarray):
        self.signs = signs.astype(np.float32)
        self.n, self.squares, self.sums = np.zeros(len(signs), np.int64), np.zeros(len(signs)), np.zeros(signs.shape)

    def add(self, rows: list[np.ndarray]) -> Sketch:
        self.n[0] += len(rows)  # at 0 all documents
        for row in rows:
            own = np.unique(row)
            self.n[own[own > 0]] += 1
        lengths = np.array([len(r) for r in rows], np.int64)
        if not lengths.sum():
            return self
        first, words = np.cumsum(lengths) - lengths, np.concatenate(rows)
        passages = -(-lengths // (BLOCK * LONG))
        passage = np.repeat(np.cumsum(passages) - passages, lengths) + (np.arange(len(words)) - np.repeat(first, lengths)) // (BLOCK * LONG)
        words, passage = words[words > 0], passage[words > 0]
        # a few passages at once: what they sum stays below 2 ** 24, where floats of 32 bits are exact
        cuts = np.append(np.searchsorted(passage, np.arange(0, passages.sum(), TOGETHER)), len(words)).tolist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                own, at = np.unique(words[low:high], return_inverse=True)
                row = passage[low:high] - passage[low]
                t = np.bincount(row * len(own) + at, minlength=(int(row[-1]) + 1) * len(own)).reshape(-1, len(own)).astype(np.float32)
                self.squares[own] += (t * t).sum(axis=0)
                self.sums[own] += t.T @ (t @ self.signs[own])
        return self

    def table(self) -> np.ndarray:
        """A row for each word: n, squares, sums."""
        return np.column_stack([self.n, self.squares.astype(np.int64), self.sums.astype(np.int64)])


def sketch_corpus(docs: DataFrame, vocabulary: dict[str, int], signs: np.ndarray) -> np.ndarray:
    """``Sketch.table`` of the whole texts of all documents (id and text), in one pass: each task sums its own, and the
    tasks' rows meet by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = WordIds(vocabulary), Sketch(signs)
        for b in batches:
            own.add(ids.of(b.column("text")))
        places, table = np.flatnonzero(own.n), own.table()
        for part in range(0, len(places), ROWS):
            some = places[part : part + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[i].tobytes() for i in some], pa.binary())], ["word", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for word, row in zip(b.column("word").to_pylist(), b.column("row").to_pylist(), strict=True):
                found[word] = found.get(word, 0) + np.frombuffer(row, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([r.tobytes() for r in found.values()], pa.binary())], ["word", "row"])

    # a task's rows are as many as the benchmark's words, so there are a few tasks for each core, not one for each small file
    tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select("text").coalesce(tasks).mapInArrow(run, "word int, row binary").repartition(SUMS, "word").mapInArrow(add, "word int, row binary")
    out = np.zeros((len(signs), signs.shape[1] + 2), np.int64)
    for r in rows.collect():  # one row for each word of the benchmark's block
        out[r["word"]] = np.frombuffer(r["row"], np.int64)
    return out


def principal(signs: np.ndarray, sums: np.ndarray, weights: np.ndarray, rank: int) -> np.ndarray:
    """The first ``rank`` right singular vectors of T diag(weights), from ``sums`` = T'(T signs) alone (Nystroem's
    approximation of the weighted products T'T, exact where ``signs`` has a column for each word)."""
    values, inner = np.linalg.eigh(signs.T @ sums)
    known = values > max(values.max(initial=0.0), 0.0) * 1e-10
    half = (weights[:, None] * sums) @ (inner[:, known] / np.sqrt(values[known]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


def build_index(docs: DataFrame, items: list[Item], *, rank: int = 96, oversample: int = 32, seed: int = 5) -> Index:
    """The index of a block of items, from frequencies and passages of all documents (id and text) and of the items; the
    items' passages together weigh as much as the corpus's, of whatever size it is."""
    names = sorted({w for it in items for w in (*it.words, *it.answer)})
    vocabulary = {w: i for i, w in enumerate(names, 1)}
    rows = [([vocabulary[w] for w in words], i, o) for i, it in enumerate(items) for o, words in it.passages()]
    signs = np.zeros((len(names) + 1, min(rank + oversample, len(names))), np.int8)
    signs[1:] = np.eye(len(names)) if len(names) <= rank + oversample else np.random.default_rng(seed).choice([-1, 1], (len(names), rank + oversample))
    corpus = sketch_corpus(docs, vocabulary, signs)
    total, n = corpus[0, 0], corpus[:, 0]
    weights = np.log((1 + total) / (1 + n)) + 1
    weights[0] = 0.0
    own = Sketch(signs).add([np.array(r[0], np.int32) for r in rows]).table()
    size, own_size = (float(x[:, 1] @ weights**2) for x in (corpus, own))
    sums = own[:, 2:] + (own_size / size if size else 0.0) * corpus[:, 2:]
    basis = principal(signs.astype(float), sums, weights, rank)
    vectors = np.zeros((len(names) + 1, basis.shape[1] + 1), np.float32)
    vectors[:, :-1] = weights[:, None] * basis
    # an unknown word is as rare as can be; of its square counts the share that the projection keeps of known ones
    kept = sum(float((vectors[r[0], :-1].sum(axis=0) ** 2).sum()) for r in rows)
    full = float(own_size)
    vectors[0, -1] = (np.log(1 + total) + 1) ** 2 * kept / max(full, 1e-9)
    latent = {}
    for size in (SHORT, LONG):
        mine = [r for r in rows if items[r[1]].blocks == size]
        if mine:
            m = np.array([vectors[r[0], :-1].sum(axis=0) for r in mine])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
            latent[size] = (np.ascontiguousarray(m.T), np.array([r[1] for r in mine]), np.array([r[2] for r in mine]))
    return Index(items, vocabulary, vectors, latent, [[vocabulary[w] for w in it.words] for it in items], [[vocabulary[w] for w in it.answer] for it in items])


def passage_vectors(vectors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the passages of ``size`` blocks, from running sums over blocks, and their first blocks."""
    last = max(0, len(vectors) - 1 - size)
    first = np.arange(0, last + 1, 1 if size == SHORT else 2)
    if first[-1] != last:
        first = np.append(first, last)
    own = vectors[np.minimum(first + size, len(vectors) - 1)] - vectors[first]
    norm = np.sqrt(np.maximum((own[:, :-1] ** 2).sum(axis=1) + np.maximum(own[:, -1], 0), 1e-9))
    return own[:, :-1] / norm[:, None], first


def matches(index: Index, ids: np.ndarray, *, cosine: float, long_cosine: float, copy_share: float, paraphrase_share: float) -> list[tuple[int, float, float, bool, int]]:
    """Items found in a text: item, cosine, share of the item's words in common, whether its answer is there, and
    the first word of the aligned region.  Passages of LONG blocks are candidates from ``long_cosine``."""
    least = min(copy_share, paraphrase_share) * index.lengths - 1e-9
    possible = Possible.of(index, ids, least)
    if possible is None:
        return []
    blocks = np.flatnonzero(possible.blocks)
    at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
    at = at[at < len(ids)]
    sums = np.zeros((len(blocks) + 1, index.vectors.shape[1]), np.float32)
    np.cumsum(np.add.reduceat(index.vectors[ids[at]], np.arange(0, len(at), BLOCK), axis=0), axis=0, out=sums[1:])
    found: dict[int, tuple[int, float, float, bool, int]] = {}
    words: list[int] | None = None
    for size, (latent, owner, offset) in index.latent.items():
        mine = possible.items[owner]
        if not mine.any():
            continue
        if not mine.all():
            latent, owner, offset = latent[:, mine], owner[mine], offset[mine]
        own, first = passage_vectors(sums, size)
        last = np.minimum(first + size, len(blocks)) - 1
        whole = blocks[last] - blocks[first] == last - first  # no passage reaches over blocks that were left out
        own, first = own[whole], blocks[first[whole]]
        bound = cosine if size == SHORT else long_cosine
        for part in range(0, len(own), PASSAGES):
            close = own[part : part + PASSAGES] @ latent
            places = np.flatnonzero(close.ravel() >= bound)
            if not len(places):
                continue
            at, which = np.divmod(places, close.shape[1])
            item, begin, near = owner[which], first[part + at] * BLOCK - offset[which], close.ravel()[places]
            low, high = region_of(begin, index.lengths[item])
            keep = possible.common(item, low, high) >= least[item]
            item, begin, near, low, high = (x[keep] for x in (item, begin, near, low, high))
            # of equal regions the closest
            order = np.argsort(-near, kind="stable")
            order = order[np.unique(item[order] * np.int64(len(ids) + index.longest + 1) + begin[order] + index.longest, return_index=True)[1]]
            low, high = low.tolist(), high.tolist()
            for j in order[np.argsort(-near[order], kind="stable")]:
                i = int(item[j])
                if i in found and found[i][2] >= copy_share:
                    continue
                if words is None:
                    words = ids.tolist()
                own_words = index.item_ids[i]
                n = len(own_words)
                a = low[j]
                region = words[a : high[j]]
                if sum(map(set(region).__contains__, own_words)) < least[i]:
                    continue  # the subsequence can't be longer than this
                share = lcs_length(own_words, region) / n
                answer = share >= paraphrase_share and holds(region, index.answer_ids[i])
                if share >= copy_share or answer:
                    new = (i, round(float(near[j]), 6), share, answer or holds(region, index.answer_ids[i]), a)
                    if i not in found or share > found[i][2]:
                        found[i] = new
    return [found[i] for i in sorted(found)]


def region_of(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the words that an item of ``n`` words is aligned with, if it seems to begin at ``begin``."""
    slack = np.maximum(8, n // 4)
    return np.maximum(0, begin - slack), np.maximum(0, begin + n + slack)


@dataclass
class Possible:
    """Which items may pass in a text: those of which a region holds enough words, which is what the subsequence can
    reach at most.  items: whether each may; blocks: the text's blocks that such regions touch, and some beside
    them; member: per spelling of the text whether it is a word of each possible item."""

    items: np.ndarray
    blocks: np.ndarray
    place: np.ndarray
    member: dict[int, np.ndarray]

    @classmethod
    def of(cls, index: Index, ids: np.ndarray, least: np.ndarray) -> Possible | None:
        here = np.zeros(len(index.vectors), bool)
        here[ids] = True
        some = np.flatnonzero(np.add.reduceat(here[index.flat], index.starts, dtype=np.int64) >= least)
        if not len(some):
            return None
        spellings = np.flatnonzero(here)
        at = np.full(len(index.vectors), -1)
        at[spellings] = np.arange(len(spellings))
        place = at[ids]
        n_blocks = -(-len(ids) // BLOCK)
        padded = np.append(place, np.full(n_blocks * BLOCK - len(ids), len(spellings)))
        items, blocks, kept = np.zeros(len(index.lengths), bool), np.zeros(n_blocks + 1, np.int32), {}
        step = max(1, CELLS // (len(ids) + 1))
        for c in range(0, len(some), step):
            part = some[c : c + step]
            own = [at[index.item_words[i]] for i in part]
            rows, columns = np.concatenate(own), np.repeat(np.arange(len(part)), [len(x) for x in own])
            member = np.zeros((len(part), len(spellings) + 1), np.uint8)
            member[columns[rows >= 0], rows[rows >= 0]] = 1
            counts = member[:, padded].reshape(len(part), n_blocks, BLOCK).sum(axis=2, dtype=np.int32)
            sums = np.zeros((len(part), n_blocks + 1), np.int32)
            np.cumsum(counts, axis=1, out=sums[:, 1:])
            n = index.lengths[part]
            # the blocks that a region of the item touches at most
            widths = np.minimum(n_blocks, (n + 2 * np.maximum(8, n // 4)) // BLOCK + 2).tolist()
            for k, (i, w) in enumerate(zip(part.tolist(), widths, strict=True)):
                enough = np.flatnonzero(sums[k, w:] - sums[k, : n_blocks + 1 - w] >= least[i])
                if len(enough):
                    enough = enough[_most_common(index, i, own[k], place, member[k], n_blocks, enough, w) >= least[i]]
                if len(enough):
                    items[i] = True
                    kept[i] = member[k]
                    np.add.at(blocks, np.maximum(enough - LONG, 0), 1)
                    np.add.at(blocks, np.minimum(enough + w + LONG, n_blocks), -1)
        return cls(items, np.cumsum(blocks)[:n_blocks] > 0, place, kept) if kept else None

    def common(self, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each region its words that are words of its item."""
        out = np.zeros(len(item), np.int64)
        order = np.argsort(item, kind="stable")
        items, start = np.unique(item[order], return_index=True)
        for i, own in zip(items.tolist(), np.split(order, start[1:]), strict=True):
            sums = np.append(0, np.cumsum(self.member[i][self.place], dtype=np.int32))
            out[own] = sums[np.minimum(high[own], len(self.place))] - sums[np.minimum(low[own], len(self.place))]
        return out


def _most_common(index: Index, item: int, at: np.ndarray, place: np.ndarray, member: np.ndarray, n_blocks: int, start: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` blocks the words that the item and the run have in common, each counted as often as
    in the one where it is rarer.  ``at``: for the item's words their places among the text's spellings, or -1."""
    row = np.full(len(member), -1)
    row[at[at >= 0]] = np.flatnonzero(at >= 0)
    words = np.flatnonzero(member[place])
    counts = np.bincount(row[place[words]] * n_blocks + words // BLOCK, minlength=len(at) * n_blocks).reshape(len(at), n_blocks)
    sums = np.zeros((len(at), n_blocks + 1), np.int32)
    np.cumsum(counts, axis=1, out=sums[:, 1:])
    return np.minimum(sums[:, start + width] - sums[:, start], index.item_counts[item][:, None]).sum(axis=0)


def holds(region: list[int], answer: list[int]) -> bool:
    """Whether the answer stands in the region as one run."""
    n = len(answer)
    return bool(n) and any(region[i : i + n] == answer for i in range(len(region) - n + 1))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, answer_words: int = 4, cosine: float = 0.1, long_cosine: float = 0.15, copy_share: float = 0.75, paraphrase_share: float = 0.6, block_items: int = 5000) -> DataFrame:
    """Pairs: the document's id, the item's id, cosine, lcs_share, answer_found."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"id {types[0]}, item string, cosine double, lcs_share double, answer_found boolean"
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    queries = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"), answer.alias("answer"))
    blocks = max(1, -(-queries.count() // block_items))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        # a block of the query set, of about block_items rows
        rows = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        items = []
        for r in sorted(rows, key=lambda r: (r["item"], r["text"] or "")):
            words = words_of(r["text"] or "")
            if words:
                items.append(Item(r["item"], words, words_of(r["answer"]) if r["answer"] else words[-answer_words:]))
        if not items:
            continue
        index = build_index(own, items)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            ids = WordIds(index.vocabulary)
            for b in batches:
                keys, found = [], []
                for row, known in enumerate(ids.of(b.column("text"))):
                    if known.any():
                        for m in matches(index, known, cosine=cosine, long_cosine=long_cosine, copy_share=copy_share, paraphrase_share=paraphrase_share):
                            keys.append(row)
                            found.append(m)
                columns = [b.column("id").take(pa.array(keys, pa.int32())), pa.array([index.items[m[0]].key for m in found], pa.string()), pa.array([m[1] for m in found], pa.float64()), pa.array([m[2] for m in found], pa.float64()), pa.array([m[3] for m in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item", "cosine", "lcs_share", "answer_found"])

        out = out.unionByName(own.mapInArrow(run, schema))
    best = out.groupBy("id", "item").agg(F.max(F.struct("lcs_share", "cosine", "answer_found")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").cast(types[1]).alias(item_col if item_col != id_col else "item_id"), "m.cosine", "m.lcs_share", "m.answer_found")
