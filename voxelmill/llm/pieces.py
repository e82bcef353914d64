"""Cutting whole Arrow batches of texts into pieces with NumPy: what byte-level tokenizers encode one by one.

A batch's UTF-8 bytes are looked at as they lie in Arrow's buffer.  Pieces are found from the kinds of code
points, named by a 64-bit hash from prefix sums, and every equality of hashes is verified on the bytes.
Texts of any length are cut to parts of bounded size where a piece begins whatever surrounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .tokens import WHITE as WHITE_CLASS

#: Kinds of code points, as the tokenizers' pattern tells them apart.
WHITE, LETTER, NUMBER, OTHER = range(4)
#: Bytes of texts that are worked on at once.
PART = 1 << 20
# Any odd multiplier does; this one has well mixed bits.
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def point_kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, f"[{WHITE_CLASS}]+")):
        for m in regex.finditer(pattern, points):
            kinds[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    return kinds


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column, without a copy; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8)


def _cut(data: np.ndarray, lo: int, hi: int) -> int:
    """The last place in (lo, hi) where white space follows something else, which begins a piece; ``lo`` if none."""
    piece = data[lo:hi]
    white = (piece == 0x20) | (piece - np.uint8(9) < 5)
    for at in np.flatnonzero(white[1:] & ~white[:-1])[::-1] + 1:
        before = piece[max(0, at - 4) : at]
        before = before[np.flatnonzero((before & 0xC0) != 0x80)[-1] :]
        if piece[at] == 0x20 and point_kinds()[ord(before.tobytes().decode())] != WHITE:
            return lo + int(at)
    return lo


def text_parts(data: np.ndarray, lo: int, hi: int, most: int = PART) -> Iterator[tuple[int, int]]:
    """Byte ranges that make up one text, each about ``most`` bytes at most where the text can be cut."""
    while hi - lo > most:
        reach, at = most, lo
        while at == lo and lo + reach < hi:
            at = _cut(data, lo, lo + reach)
            reach *= 2
        if at == lo:
            break
        yield lo, at
        lo = at
    yield lo, hi


def batches(offsets: np.ndarray, data: np.ndarray, most: int = PART) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, begin, end) in order, each list of about ``most`` bytes; long texts come in several parts."""
    out, held = [], 0
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for a, b in [(lo, hi)] if hi - lo <= most else text_parts(data, lo, hi, most):
            if out and held + b - a > most:
                yield out
                out, held = [], 0
            out.append((i, a, b))
            held += b - a
    if out:
        yield out


def pattern_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte offsets at which the matches of the tokenizers' pattern begin; ``begins`` are those of the texts in ``data``.

    A white run gives its last character to what follows if that character is a space, and stands apart
    else; an apostrophe that begins a match takes one of the known endings along."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    where = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[n:] = True
    first[np.searchsorted(where, begins[begins < len(data)])] = True
    kind = point_kinds()[points]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = (kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first[1:n]
    start[:-1] |= last
    start[1:] &= ~(last & (points[:-1] == 0x20))
    at = np.flatnonzero((points == 0x27) & start)
    if len(at):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = padded[at + 1], padded[at + 2]
        short = ~first[at + 1] & np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        pair &= ~first[at + 1] & ~first[at + 2]
        start[at[short | pair] + 1] = False
        after = np.concatenate([at[short] + 2, at[pair] + 3])
        start[after[after < n]] = True
    return where[start]


def space_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Byte offsets at which runs of spaces, or texts, begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    start = data == 0x20
    start[1:] &= ~start[:-1].copy()
    start[begins[begins < len(data)]] = True
    return np.flatnonzero(start)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for usual sizes."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    size = max(n, PART + 1)
    tables = []
    for base in (BASE, inverse):
        t = np.full(size, base, np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        tables.append(t)
    if size <= 4 * PART:
        _powers[:] = tables
    return tables[0], tables[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each piece's bytes, the same wherever the piece stands."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each piece equals the bytes of its length that begin in ``other`` at ``others``."""
    differs = data[spread(starts, lengths)] != other[spread(others, lengths)]
    sums = np.zeros(len(differs) + 1, np.int64)
    np.cumsum(differs, out=sums[1:])
    ends = np.cumsum(lengths)
    return sums[ends] == sums[ends - lengths]


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the distinct pieces, and for each piece which of them it is.  Pieces of equal hash are verified;
    one whose bytes differ stands for itself."""
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, like = ends - starts, first[of]
    same = lengths == lengths[like]
    at = np.flatnonzero(same & (like != np.arange(len(like))))
    same[at] = same_bytes(data, starts[at], lengths[at], data, starts[like[at]])
    odd = np.flatnonzero(~same)
    of[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), of


class Stack:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.all, self.n = np.zeros(1024, dtype), 0

    def push(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(self.n + 2 * len(values), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)

    def keep(self, at: np.ndarray) -> None:
        self.n, self.all = len(at), self.all[at]


class Remembered:
    """Ids of pieces as ``encode`` gives them, each piece once while it is remembered: found by hash, verified by bytes.

    With more than ``most`` pieces, those that were not used lately are forgotten."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 500_000):
        self.encode, self.most, self.clock = encode, most, 0
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hashes
        self.data, self.ids = Stack(np.uint8), Stack(np.int32)
        self.start, self.length, self.first, self.count, self.used = (Stack(np.int64) for _ in range(5))

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the distinct pieces; which of them each piece is; all distinct pieces' ids; how many each has."""
        which, of = distinct_pieces(data, starts, ends, hashes)
        begin, size, h = starts[which], (ends - starts)[which], hashes[which]
        self.clock += 1
        at, taken = np.searchsorted(self.hashes, h), np.zeros(len(h), bool)
        entry, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if len(self.hashes):
            near = np.minimum(at, len(self.hashes) - 1)
            taken, entry = self.hashes[near] == h, self.entry[near]
            known = taken & (self.length.all[entry] == size)
            there = np.flatnonzero(known)
            known[there] = same_bytes(data, begin[there], size[there], self.data.all, self.start.all[entry[there]])
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        lists = self.encode([raw[a : a + n] for a, n in zip(begin[new].tolist(), size[new].tolist())])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        entry[new] = self.start.n + np.arange(len(new))
        self.first.push(self.ids.n + np.cumsum(counts) - counts)
        self.count.push(counts)
        self.ids.push(np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())))
        self.start.push(self.data.n + np.cumsum(size[new]) - size[new])
        self.length.push(size[new])
        self.data.push(data[spread(begin[new], size[new])])
        self.used.push(np.zeros(len(new), np.int64))
        self.used.all[entry] = self.clock
        # A hash names one piece of the table.  Distinct pieces come in order of hashes, then those whose hash came before.
        fresh = new[~taken[new] & (new < (np.argmax(h[1:] <= h[:-1]) + 1 if (h[1:] <= h[:-1]).any() else len(h)))]
        self.hashes, self.entry = np.insert(self.hashes, at[fresh], h[fresh]), np.insert(self.entry, at[fresh], entry[fresh])
        counts = self.count.all[entry]
        ids = self.ids.all[spread(self.first.all[entry], counts)]
        if self.start.n > self.most:
            self.forget()
        return which, of, ids, counts

    def forget(self) -> None:
        """Keep the half that was used last, of the pieces that can be found."""
        used = self.used.all[: self.used.n]
        kept = np.zeros(len(used), bool)
        kept[self.entry] = True
        kept &= used > np.partition(used, len(used) // 2)[len(used) // 2]
        keep, stay = np.flatnonzero(kept), kept[self.entry]
        self.hashes, self.entry = self.hashes[stay], (np.cumsum(kept) - 1)[self.entry[stay]]
        self.data.keep(spread(self.start.all[keep], self.length.all[keep]))
        self.ids.keep(spread(self.first.all[keep], self.count.all[keep]))
        for s in (self.length, self.count, self.used):
            s.keep(keep)
        for s, sizes in ((self.start, self.length), (self.first, self.count)):
            s.keep(keep)
            s.all[:] = np.cumsum(sizes.all) - sizes.all
