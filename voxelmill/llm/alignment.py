"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how often across the corpus.

Each text is encoded by a byte-level BPE (side A) and by a piece BPE with byte fallback (side B).  The places where
tokens of both end cut it into groups; ids of a group are linked.  Tokenizers encode each distinct piece of a
batch once, as no merge of A crosses its pattern's pieces and none of B a run of spaces that begins a word.

Postings: per document, each linked pair and how often it is linked there.  A task gathers the postings of many
documents to blocks, so a block's row is a pair with its documents.  Blocks are shuffled by the pair's ids as sorted
streams that spill, beside the pairs' counts, of which an A id has no more than B has entries; where both streams
meet, a document's contribution is computed, and contributions are summed by document.  A pair that very many
documents hold is split by Spark.

Defined results: texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros
and an empty string.  Rows that repeat an id are documents of their own, null ids too; extra columns are
ignored, an empty table gives no rows; text that spells a special token is ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import Remembered, pattern_starts, piece_hashes, same_bytes, space_starts, spread, string_buffers, text_parts
from .shared import Scratch, small_batches, stored

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pieces whose ids a worker remembers, on each side.
REMEMBER = 600_000
#: Postings of a block: rows of a task are gathered until there are so many.
BLOCK = 2_000_000
#: Bytes of texts that are aligned at once.
PART = 1 << 20
#: Links of a group beyond which its distinct ids are paired instead of its tokens.
MANY = 64


class ByteSide:
    """Side A: pieces of the pattern, bytes of entries by the byte-level alphabet."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, others for the points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        n = self.own.get_vocab_size(with_added_tokens=True)
        special = self.own.get_added_tokens_decoder()
        self.entries = [special[i].content.encode() if i in special else bytes(alphabet[c] for c in self.own.id_to_token(i)) for i in range(n)]

    starts = staticmethod(pattern_starts)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch([p.decode() for p in pieces], add_special_tokens=False)]


class PieceSide:
    """Side B: words with the spaces before them; the model adds the first space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        of = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(of)]

    starts = staticmethod(space_starts)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        space = [self.own.piece_to_id("▁")]  # of no text the model makes nothing
        return [x or space for x in self.own.encode([p[1:].decode() for p in pieces], num_threads=1)]


class Side:
    """One tokenizer: entries' bytes, and the ids of pieces."""

    def __init__(self, own: ByteSide | PieceSide):
        self.own = own
        self.sizes = np.array([len(e) for e in own.entries], np.int64)
        self.offsets, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(own.entries), np.uint8)
        self.bits = max(1, (len(own.entries) - 1).bit_length())
        self.known = Remembered(own.encode, REMEMBER)

    def encode(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts in ``data``, where the tokens end by their entries' bytes, and whether each text comes back.

        Ends count in a text that does not come back, too, but are of no use there."""
        starts = self.own.starts(data, begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        which, of, flat, sizes = self.known.ids_of(data, starts, ends, piece_hashes(data, starts, ends))
        upto = np.cumsum(sizes)
        # A distinct piece comes back if its entries have its length and bytes.
        spans = np.append(0, np.cumsum(self.sizes[flat]))
        length = spans[upto] - spans[upto - sizes]
        good = length == (ends - starts)[which]
        joined = self.data[spread(self.offsets[flat], self.sizes[flat])]
        at = np.flatnonzero(good)
        good[at] = same_bytes(data, starts[which][at], length[at], joined, spans[upto - sizes][at])
        n = sizes[of]
        tokens = flat[spread((upto - sizes)[of], n)]
        after = np.cumsum(n)
        token_ends = np.repeat(starts, n) + np.cumsum(self.sizes[tokens])
        token_ends -= np.repeat(np.append(0, np.cumsum(self.sizes[tokens]))[after - n], n)
        text = np.searchsorted(begins, starts, "right") - 1
        comes_back = np.ones(len(begins), bool)
        comes_back[text[~good[of]]] = False
        return tokens.astype(np.int64), token_ends, comes_back


_sides: dict[tuple[str, str], Side] = {}


def side(kind: str, path: str) -> Side:
    """The tokenizer of the file, read once in each worker."""
    if (kind, path) not in _sides:
        _sides[kind, path] = Side(ByteSide(path) if kind == "byte" else PieceSide(path))
    return _sides[kind, path]


def _pair_distinct(group: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group, and how often each is there."""
    keys, times = np.unique(group << bits | ids, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), times


def linked(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All A-B pairs of tokens of the same group: group, A id, B id, times."""
    times_a, times_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    many = np.bincount(in_a, minlength=groups) * np.bincount(in_b, minlength=groups) > MANY
    if many.any():
        big_a, big_b = many[in_a], many[in_b]
        ga, ia, ta = _pair_distinct(in_a[big_a], a[big_a], 24)
        gb, ib, tb = _pair_distinct(in_b[big_b], b[big_b], 24)
        in_a, a, times_a = np.append(in_a[~big_a], ga), np.append(a[~big_a], ia), np.append(times_a[~big_a], ta)
        in_b, b, times_b = np.append(in_b[~big_b], gb), np.append(b[~big_b], ib), np.append(times_b[~big_b], tb)
        order = np.argsort(in_b, kind="stable")
        in_b, b, times_b = in_b[order], b[order], times_b[order]
    n_b = np.bincount(in_b, minlength=groups)
    first = np.cumsum(n_b) - n_b
    n = n_b[in_a]
    at = spread(first[in_a], n)
    return np.repeat(in_a, n), np.repeat(a, n), b[at], np.repeat(times_a, n) * times_b[at]


def group_strings(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, cuts: np.ndarray, names: list[str]) -> list[str]:
    """For each text (groups from ``cuts[i]`` to ``cuts[i + 1]``) its groups as text: ids of A, a bar, ids of B."""
    groups = int(cuts[-1])
    n_a, n_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    sizes = n_a + n_b
    ends = np.append(0, np.cumsum(sizes))
    mark = np.zeros(ends[-1], np.int64)  # a comma follows
    mark[ends[:-1] + n_a - 1] = 1  # a bar
    mark[ends[1:] - 1] = 2  # a semicolon
    bounds = ends[cuts]
    mark[bounds[1:] - 1] = 3  # nothing
    ids = mark * (len(names) // 4)
    ids[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[in_a]] += a
    ids[np.arange(len(b)) + np.cumsum(n_a)[in_b]] += b
    said = list(map(names.__getitem__, ids.tolist()))
    return ["".join(said[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Aligned(NamedTuple):
    """Texts that come back from both sides: counts per text, and each token's group."""

    n_a: np.ndarray
    n_b: np.ndarray
    cuts: np.ndarray
    a: np.ndarray
    in_a: np.ndarray
    b: np.ndarray
    in_b: np.ndarray


def align(a: Side, b: Side, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, Aligned]:
    """Which texts of ``data`` come back from both sides, and the alignment of these."""
    ids_a, ends_a, good = a.encode(data, begins)
    ids_b, ends_b, back = b.encode(data, begins)
    good &= back
    if not good.all():  # ends in a text that does not come back say nothing
        lengths = np.diff(np.append(begins, len(data)))[good]
        return good, align(a, b, data[spread(begins[good], lengths)], np.cumsum(lengths) - lengths)[1]
    bounds = np.append(begins, len(data))
    cut = np.zeros(len(data) + 1, np.int8)
    cut[ends_a] = 1
    cut[ends_b] += 1
    cut >>= 1
    groups = np.cumsum(cut, dtype=np.int64)  # that end here or before
    count = lambda ends: np.diff(np.searchsorted(ends, bounds, "right"))
    return good, Aligned(count(ends_a), count(ends_b), groups[bounds], ids_a, groups[ends_a] - cut[ends_a], ids_b, groups[ends_b] - cut[ends_b])


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


class Gatherer:
    """What one task aligns: rows of documents, and the postings of the block at hand."""

    def __init__(self, a: Side, b: Side, partition: int):
        self.a, self.b = a, b
        self.names = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(max(len(a.sizes), len(b.sizes)))]
        self.base, self.block, self.keys, self.times, self.held = partition << 40, 0, [], [], 0
        self.bits = 63 - a.bits - b.bits
        self.next = 0

    def postings(self, found: Aligned, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of (A id, B id, row of the block), their times, and the links of each text."""
        group, a, b, times = linked(found.a, found.in_a, found.b, found.in_b, int(found.cuts[-1]))
        text = np.searchsorted(found.cuts, group, "right") - 1
        keys, times = summed((a << self.b.bits | b) << self.bits | rows[text], times)
        n = np.bincount(found.in_a, minlength=found.cuts[-1]) * np.bincount(found.in_b, minlength=found.cuts[-1])
        return keys, times, np.diff(np.append(0, np.cumsum(n))[found.cuts])

    def hold(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.held += len(keys)

    def texts(self, data: np.ndarray, offsets: np.ndarray, which: list[int], out: list) -> None:
        """Short texts together; ``out[i]`` becomes the row of text i."""
        begins, data = with_spaces(data, [(int(offsets[i]), int(offsets[i + 1])) for i in which], [True] * len(which))
        good, found = align(self.a, self.b, data, begins)
        which = [i for i, ok in zip(which, good.tolist()) if ok]
        if not which:
            return
        rows = np.array([out[i][0] for i in which], np.int64) - self.base - self.block
        keys, times, links = self.postings(found, rows)
        self.hold(keys, times)
        says = group_strings(found.a, found.in_a, found.b, found.in_b, found.cuts, self.names)
        for i, *figures in zip(which, found.n_a.tolist(), found.n_b.tolist(), np.diff(found.cuts).tolist(), links.tolist(), says):
            out[i][1:] = figures

    def long_text(self, data: np.ndarray, lo: int, hi: int, row: list) -> None:
        """A text in parts, each of which begins where both sides cut; nothing if one part does not come back."""
        parts = [with_spaces(data, [p], [p[0] == lo]) for p in text_parts(data, lo, hi, PART)]
        for begins, part in parts:
            for s in (self.a, self.b):
                if not s.encode(part, begins)[2].all():
                    return
        own = np.array([row[0] - self.base - self.block], np.int64)
        figures, says, keys, times = np.zeros(4, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begins, part in parts:
            _, found = align(self.a, self.b, part, begins)
            k, t, links = self.postings(found, own)
            keys, times = summed(np.append(keys, k), np.append(times, t))
            figures += (found.n_a[0], found.n_b[0], found.cuts[-1], links[0])
            says += group_strings(found.a, found.in_a, found.b, found.in_b, found.cuts, self.names)
        self.hold(keys, times)
        row[1:] = [*figures.tolist(), ";".join(says)]

    def documents(self, column: pa.Array) -> list[list]:
        """A row for each text: its key, numbers of A and B tokens, of groups and links, and its groups."""
        offsets, data = string_buffers(column)
        out = [[self.base + self.next + i, 0, 0, 0, 0, ""] for i in range(len(column))]
        self.next += len(column)
        short, held = [], 0
        for i, size in enumerate(np.diff(offsets).tolist()):
            if size > PART:
                self.long_text(data, int(offsets[i]), int(offsets[i + 1]), out[i])
            elif size:
                if held + size > PART and short:
                    self.texts(data, offsets, short, out)
                    short, held = [], 0
                short.append(i)
                held += size
        if short:
            self.texts(data, offsets, short, out)
        return out

    def flush(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The block's postings by pair: A id, B id, offsets, documents, times."""
        if self.held:
            keys, times = np.concatenate(self.keys), np.concatenate(self.times)
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            pair = keys >> self.bits
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            docs = (keys & ((1 << self.bits) - 1)) + self.base + self.block
            yield pair[first] >> self.b.bits, pair[first] & ((1 << self.b.bits) - 1), np.append(first, len(keys)), docs, times
        self.block, self.keys, self.times, self.held = self.next, [], [], 0


def with_spaces(data: np.ndarray, ranges: list[tuple[int, int]], spaced: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Where the byte ranges begin and their bytes, with a space before those that want one."""
    starts = np.array([a for a, _ in ranges], np.int64)
    lengths, more = np.array([b - a for a, b in ranges], np.int64), np.array(spaced, np.int64)
    sizes = lengths + more
    begins = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    out[spread(begins + more, lengths)] = data[spread(starts, lengths)]
    return begins, out


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Rows of two kinds.  Of documents: ``row`` (unique), ``doc_id``, counts, and ``groups`` (``a1,a2|b1;a3|b2``).  Of
    blocks' pairs: ids ``a`` and ``b``, the rows of the ``docs`` that link them, and how many ``times`` each does.

    ``row`` depends on how the table is split, so these rows have a meaning only once they are stored."""
    small_batches(docs.sparkSession)
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(columns.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {id_type}, {', '.join(f'{c} bigint' for c in FIGURES)}, groups string, a int, b int, n_docs int, docs array<bigint>, times array<int>"
    names = ["row", "doc_id", *FIGURES, "groups", "a", "b", "n_docs", "docs", "times"]

    def blocks(own: Gatherer, like: pa.DataType) -> Iterator[pa.RecordBatch]:
        for a, b, offsets, docs, times in own.flush():
            for lo in range(0, len(a), 50_000):
                some = slice(lo, min(lo + 50_000, len(a)))
                ends = offsets[lo : some.stop + 1]
                inner, n = slice(ends[0], ends[-1]), some.stop - lo
                lists = [pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(x[inner], t)) for x, t in ((docs, pa.int64()), (times, pa.int32()))]
                none = [pa.nulls(n, t) for t in (pa.int64(), like, *[pa.int64()] * len(FIGURES), pa.string())]
                yield pa.RecordBatch.from_arrays([*none, *(pa.array(x, pa.int32()) for x in (a[some], b[some], np.diff(ends))), *lists], names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, like = Gatherer(side("byte", byte_bpe), side("piece", piece_bpe), TaskContext.get().partitionId()), None
        for batch in rows:
            ids, like = batch.column("doc_id"), batch.schema.field("doc_id").type
            found = list(zip(*own.documents(batch.column("text")))) or [()] * 6
            made = [pa.array(x, t) for x, t in zip(found, [pa.int64()] * 5 + [pa.string()])]
            none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([made[0], ids, *made[1:], *none], names)
            if own.held >= BLOCK:
                yield from blocks(own, like)
        if like is not None:
            yield from blocks(own, like)

    return columns.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Per pair: ``n``, the documents that link it, and ``best``, the most that any pair of its A id has.

    Blocks are summed before they are shuffled; an A id has at most one row for each entry of B."""
    counts = blocks.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    return counts.withColumn("best", F.max("n").over(Window.partitionBy("a")))


def align_tokenizers(docs: DataFrame, *, groups: str = "groups", **options) -> DataFrame:
    """Per document: ``doc_id``, the counts of tokens, groups and links, ``n_best`` (links whose pair is as frequent as any
    of its A id), ``count_sum`` (over links, the documents of the pair), and ``groups``, an SQL expression over the groups."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.stored(aligned_rows(docs, **options).withColumn("groups", F.expr(groups)), "aligned")
        blocks = rows.where("a IS NOT NULL").select("a", "b", "n_docs", "docs", "times")
        counts = scratch.stored(pair_counts(blocks), "aligned-pairs")
        met = blocks.join(counts, ["a", "b"]).select("n", (F.col("n") == F.col("best")).alias("is_best"), F.inline(F.arrays_zip("docs", "times")))
        sums = met.groupBy(F.col("docs").alias("row")).agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        documents = rows.where("row IS NOT NULL").select("row", "doc_id", *FIGURES, "groups")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        return stored(documents.join(sums, "row", "left").select("doc_id", *FIGURES, zero("n_best"), zero("count_sum"), "groups"), "alignment")
