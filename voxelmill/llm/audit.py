"""Filter interaction audit: what each of several filters removes, in every order of them.

Texts are scanned in Arrow's buffers: NumPy byte classes and prefix sums count words, capitals and symbols; a
document's word hashes are sorted, equal neighbours verified on their bytes, so distinct words are exact.
Each document becomes a mask of the filters it fails; masks are counted by part, and everything about
orders, redundancy and Shapley shares follows from at most 2^n counts a part.

Copies are found by SHA-256: the least id of each text that occurs more than once is a table, joined on the digest; Spark
splits a digest with very many rows.

Defined results: a null text is empty, a null part is the empty string.  A null id is not smaller than any and never a
copy; rows that repeat an id are no copies of each other.  Labels that repeat an id count by their maximum; rows
without a label are neither good nor toxic.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import batches, piece_hashes, same_bytes, string_buffers
from .shared import Scratch, small_batches, stored

SYMBOLS = "#$%&*|"
#: A filter's condition of failure, in SQL over the statistics.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_points",
    "D": "n_symbols > 0",
    "E": "is_copy",
}
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def byte_classes(symbols: str) -> np.ndarray:
    """For each byte: 1 white space, 2 a capital, 4 a symbol, 8 the first byte of a code point."""
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] |= 1
    kinds[ord("A") : ord("Z") + 1] |= 2
    kinds[[ord(c) for c in symbols]] |= 4
    kinds[[b for b in range(256) if b & 0xC0 != 0x80]] |= 8
    return kinds


def words_of(kinds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a text's end, which is the next one's beginning, ends a word."""
    inside = np.zeros(len(kinds) + 2, bool)
    inside[1:-1] = (kinds & 1) == 0
    edge = np.zeros(len(kinds) + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many different words each text has; text i has the words from ``upto[i]`` to ``upto[i + 1]``."""
    hashes = piece_hashes(data, starts, ends)
    order = np.empty(len(starts), np.int64)
    bounds = upto.tolist()
    for a, b in zip(bounds, bounds[1:]):
        order[a:b] = hashes[a:b].argsort()
        order[a:b] += a
    ordered = hashes[order]
    again = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    again = again[~np.isin(again, upto)]
    here, there = order[again], order[again - 1]
    sizes = ends - starts
    same = sizes[here] == sizes[there]
    at = np.flatnonzero(same)
    same[at] = same_bytes(data, starts[here[at]], sizes[here[at]], data, starts[there[at]])
    text = np.searchsorted(upto, again, "right") - 1
    found = np.diff(upto) - np.bincount(text, minlength=len(upto) - 1)
    for i in np.unique(text[~same]).tolist():  # two words share a hash
        found[i] = len({data[a:b].tobytes() for a, b in zip(starts[upto[i] : upto[i + 1]], ends[upto[i] : upto[i + 1]])})
    return found


def scan(column: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The counts of each text (a row per name in ``COUNTS``) and its digest."""
    offsets, data = string_buffers(column)
    counts = np.zeros((len(COUNTS), len(column)), np.int64)
    long: dict[int, set[bytes]] = {}  # words of the texts that come in several parts
    for part in batches(offsets, data):
        which, lo = np.array([i for i, _, _ in part]), part[0][1]
        here = data[lo : part[-1][2]]
        begins = np.array([a for _, a, _ in part]) - lo
        kinds = classes[here]
        bounds = np.append(begins, len(here))
        starts, ends = words_of(kinds, begins)
        upto = np.searchsorted(starts, bounds)
        np.add.at(counts[0], which, np.diff(upto))
        counts[1, which] = distinct_words(here, starts, ends, upto)
        for k, (i, a, b) in enumerate(part):
            if b - a < offsets[i + 1] - offsets[i]:
                own = slice(upto[k], upto[k + 1])
                long.setdefault(i, set()).update(here[x:y].tobytes() for x, y in zip(starts[own].tolist(), ends[own].tolist()))
        for row, bit in ((2, 2), (3, 8), (4, 4)):
            sums = np.zeros(len(here) + 1, np.int64)
            np.cumsum((kinds & bit) != 0, out=sums[1:])
            np.add.at(counts[row], which, np.diff(sums[bounds]))
    for i, words in long.items():
        counts[1, i] = len(words)
    return counts, [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", symbols: str = SYMBOLS) -> DataFrame:
    """Per row: ``id``, ``part``, the counts and ``digest``, the text's SHA-256."""
    small_batches(docs.sparkSession)
    columns = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    schema = f"id {dict(columns.dtypes)['id']}, part string, {', '.join(f'{c} bigint' for c in COUNTS)}, digest binary"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes(symbols)
        for b in rows:
            counts, digests = scan(b.column("text"), classes)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), *map(pa.array, counts), pa.array(digests, pa.binary())], ["id", "part", *COUNTS, "digest"])

    return columns.mapInArrow(run, schema)


def with_copies(statistics: DataFrame, scratch: Scratch) -> DataFrame:
    """``statistics``, a table, with ``is_copy``: whether a smaller id has the same text."""
    firsts = statistics.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = scratch.stored(firsts.select("digest", "first"), "audit-firsts")
    out = statistics.join(firsts, "digest", "left")
    return out.withColumn("is_copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("first")


def failure_counts(statistics: DataFrame, labels: DataFrame, filters: dict[str, str], scratch: Scratch) -> DataFrame:
    """Per part and mask of failed filters (bit i for the i-th filter): documents, good ones and toxic ones."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = scratch.stored(known.select(F.col("doc_id").alias("id"), "quality", "toxic"), "audit-labels")
    mask = sum((F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    masked = statistics.select("id", "part", mask.alias("mask")).join(known, "id", "left")
    one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0))
    return masked.groupBy("part", "mask").agg(F.count("*").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the filters and step in it: what the step's filter does there.

    The counts of a part are one array of at most 2^n entries, and each figure is a sum over some of them."""
    orders = ["".join(p) for p in permutations(letters)]
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    held = held.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, len(letters) + 1)))))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), F.col("filter_order").substr(F.col("step"), F.lit(1)))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    held = held.withColumn("bit", bit).withColumn("before", before)

    def total(of: str, when) -> Column:
        picked = F.filter("masks", lambda m: when(m["mask"]))
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda s, m: s + m[of])

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # Of a document that fails k filters, each of them removes it in one k-th of the orders.
    share = F.aggregate(F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("bigint"), lambda s, m: s + (m["n"] * len(orders) / F.bit_count(m["mask"])).cast("bigint"))
    return held.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, filters: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of ``filters`` (a letter and its condition of failure each) over ``docs``, a stored table."""
    filters = filters or FILTERS
    with Scratch(docs.sparkSession) as scratch:
        statistics = scratch.stored(text_statistics(docs, id_col=id_col, text_col=text_col, part_col=part_col), "audit-statistics")
        counts = failure_counts(with_copies(statistics, scratch), labels, filters, scratch)
        return stored(interactions(counts, "".join(filters)), "filter-audit")


#: Each document's failing letters, the first step that removes it, and sums.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^ 	-
]+') AS words, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS capitals,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS is_copy FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * capitals > 2 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN is_copy THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c3.c || c4.c || c5.c AS o FROM c a, c b, c c3, c c4, c c5
  WHERE len(list_distinct([a.c, b.c, c3.c, c4.c, c5.c])) = 5),
p AS (SELECT *, coalesce(list_min([i FOR i IN [1, 2, 3, 4, 5] IF contains(fails, o[i])]), 6) AS gone_at FROM n, o),
s AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS letter,
  CAST(sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone_at < step AND contains(fails, o[step]) THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = o[step] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone_at = step THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""
