"""Byte-level BPE in two tiers: a minimal perfect hash for whole pieces, a heap over linked bytes for the rest.

Texts are cut by the tokenizers' pattern.  A piece that is itself an entry of the vocabulary is its id; a minimal
perfect hash finds the only entry that it can be, and its bytes are compared.  Every other distinct piece is
merged once: its bytes are a linked list, a heap has the rank of each neighbouring pair, and the lowest rank,
leftmost first, is merged until no pair is an entry.  ``decode`` gathers the entries' bytes.

Defined results: null and empty texts have no ids, and no ids decode to no bytes; null ids decode to null; an
id outside the vocabulary is an error that names it.  Repeated rows are encoded each time, other columns
stay as they are (``ids`` and ``decoded`` replace columns of that name); text that spells a special token is
ordinary text.  Runs of one kind and texts may have any length: texts are cut to parts where a piece begins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Remembered, batches, mixed, pattern_starts, piece_hashes, same_bytes, spread, string_buffers
from .shared import small_batches

#: Merged pieces that a worker remembers.
REMEMBER = 600_000
#: Bits of an id where two are one number.
ID_BITS = 24
#: Entries of the vocabulary in a bucket of the perfect hash, on average.
BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merging_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of every two entries that make an entry, by their ids in one number."""
    get = ranks.get
    return {
        left << ID_BITS | right: rank
        for entry, rank in ranks.items()
        for at in range(1, len(entry))
        if (left := get(entry[:at])) is not None and (right := get(entry[at:])) is not None
    }


def heap_merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a piece from those of its bytes: the pair of the lowest rank, leftmost first, is merged while there is one.

    ``rank[i]`` is that of the pair that begins at ``i``; an entry of the heap that says otherwise is out of date."""
    n, get = len(ids), pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [get(a << ID_BITS | b, -1) for a, b in zip(ids, ids[1:])]
    rank.append(-1)
    heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if rank[i] != r:
            continue
        j = after[i]
        ids[i], rank[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank[i] = s = get(r << ID_BITS | ids[k], -1)
            if s >= 0:
                heappush(heap, s * n + i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            rank[h] = s = get(ids[h] << ID_BITS | r, -1)
            if s >= 0:
                heappush(heap, s * n + h)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class PerfectHash:
    """A minimal perfect hash of byte strings: buckets of keys are placed, large ones first, by the first displacement
    that puts all of them on free slots; buckets of one key name their slot outright."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        sizes = np.array([len(k) for k in keys], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(keys), np.uint8)
        hashes = piece_hashes(data, ends - sizes, ends)
        if len(np.unique(hashes)) < n:
            raise ValueError("two entries of the vocabulary have the same hash")
        bucket = (hashes % np.uint64(max(1, n // BUCKET))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        self.shift, taken = np.zeros(max(1, n // BUCKET), np.int64), np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        for g in sorted(groups, key=len, reverse=True):
            if len(g) == 1:
                break
            tried, step = 0, 64
            while True:
                slots = self._slots(hashes[g], np.arange(tried, tried + step)[:, None])
                ok = ~taken[slots].any(1)
                ok &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if ok.any():
                    break
                tried, step = tried + step, min(4096, 2 * step)
            k = int(np.flatnonzero(ok)[0])
            self.shift[bucket[g[0]]], slot_of[g] = tried + k, slots[k]
            taken[slots[k]] = True
        free = iter(np.flatnonzero(~taken).tolist())
        for g in groups:
            if len(g) == 1:
                slot_of[g[0]] = s = next(free)
                self.shift[bucket[g[0]]] = -s - 1
        at = np.argsort(slot_of)  # the key of each slot
        self.key, self.sizes, self.data = at, sizes[at], data
        self.starts = (ends - sizes)[at]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(hashes + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.n)).astype(np.int64)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The index of the key that equals each piece, -1 if none does."""
        shift = self.shift[(hashes % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, self._slots(hashes, shift))
        size = ends - starts
        maybe = np.flatnonzero(self.sizes[slot] == size)
        hit = maybe[same_bytes(data, starts[maybe], size[maybe], self.data, self.starts[slot[maybe]])]
        out = np.full(len(starts), -1, np.int64)
        out[hit] = self.key[slot[hit]]
        return out


class Vocabulary:
    """A rank file as the worker needs it: the perfect hash, ranks of byte strings, bytes of ids.  Ids are ranks, as in the rank files."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids, self.pairs = [ranks[bytes([b])] for b in range(256)], merging_pairs(ranks)
        entries = list(ranks)
        self.hash, self.id_of = PerfectHash(entries), np.array([ranks[e] for e in entries], np.int32)
        self.sizes = np.full(max(ranks.values()) + 1, -1, np.int64)
        self.sizes[self.id_of] = [len(e) for e in entries]
        self.starts, self.data = np.zeros(len(self.sizes), np.int64), self.hash.data
        self.starts[self.id_of] = np.cumsum([0, *map(len, entries)])[:-1]
        self.known = Remembered(lambda pieces: [heap_merge([self.byte_ids[b] for b in p], self.pairs) for p in pieces], REMEMBER)

    def encode(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``data``, which begin at ``begins``, and how many each text has."""
        starts = pattern_starts(data, begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = piece_hashes(data, starts, ends)
        key = self.hash.find(data, starts, ends, hashes)
        counts, rest = np.ones(len(starts), np.int64), np.flatnonzero(key < 0)
        _, of, flat, sizes = self.known.ids_of(data, starts[rest], ends[rest], hashes[rest])
        counts[rest] = sizes[of]
        after = np.cumsum(counts)
        ids = np.empty(after[-1] if len(after) else 0, np.int32)
        whole = np.flatnonzero(key >= 0)
        ids[after[whole] - 1] = self.id_of[key[whole]]
        ids[spread(after[rest] - counts[rest], counts[rest])] = flat[spread((np.cumsum(sizes) - sizes)[of], counts[rest])]
        upto = np.append(0, after)[np.searchsorted(starts, np.append(begins, len(data)))]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where each id's bytes end."""
        wrong = (ids < 0) | (ids >= len(self.sizes))
        wrong[~wrong] = self.sizes[ids[~wrong]] < 0
        if wrong.any():
            raise ValueError(f"id {ids[wrong][0]} is not in the vocabulary")
        sizes = self.sizes[ids]
        return self.data[spread(self.starts[ids], sizes)], np.cumsum(sizes)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of the file, read once in each worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(read_ranks(path))
    return _vocabularies[path]


def encode_column(column: pa.Array, own: Vocabulary) -> pa.Array:
    """A list of ids for each text."""
    offsets, data = string_buffers(column)
    counts, ids = np.zeros(len(column), np.int64), []
    for part in batches(offsets, data):
        which = np.array([i for i, _, _ in part])
        lo = part[0][1]
        here, n = own.encode(data[lo : part[-1][2]], np.array([a for _, a, _ in part]) - lo)
        np.add.at(counts, which, n)
        ids.append(here)
    ends = np.append(0, np.cumsum(counts))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def decode_column(column: pa.Array, own: Vocabulary) -> pa.Array:
    """The bytes of each list of ids."""
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    data, after = own.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.append(0, after)[np.append(0, np.cumsum(sizes))]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    out = out.cast(pa.binary())
    return pa.array(out.to_pylist(), pa.binary(), mask=np.asarray(column.is_null())) if column.null_count else out


def _mapped(df: DataFrame, name: str, kind: str, source: str, what, path: str) -> DataFrame:
    """``df`` with a column ``name`` that ``what`` makes of the column ``source``."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != name]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes] + [f"`{name}` {kind}"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for b in rows:
            made = what(b.column(source), own)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), made], [*keep, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the ids of each whole text by the ranks in the file ``path``."""
    return _mapped(docs, "ids", "array<int>", text_col, encode_column, path)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""
    return _mapped(encoded, "decoded", "binary", ids_col, decode_column, path)
