"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

The statistics of a text are array expressions over its words and lines; nothing is exploded, so no
text meets a shuffle.  A decision list is learned from labelled statistics by sequential covering:
a rule (a conjunction of thresholds) grows on one part of the labelled rows by information gain, is
pruned on the other part, and the rows that it covers leave before the next rule grows.  The list
becomes one ordered Spark conditional expression.

Defined results: a null text has the statistics of an empty one (all zero) and fails the base rule;
without labelled rows of both classes the list is empty and keeps what the base rule keeps.  Repeated
rows are judged alike, extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8

#: What rules may test: name and SQL over the statistics.
FEATURES = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "stutter_share": "n_stutter / greatest(n_words, 1)",
}


def text_statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines,
    n_upper, n_marks, n_stutter (words equal to the next one) that rules may use."""
    cols = [F.col(c) for c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*cols, text.alias("_t"))
    out = out.select(
        *cols,
        F.array_remove(F.split("_t", SPACE, -1), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-ZÀ-ÖØ-Þ]+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("_t", "[^!?:;]+", "")).cast("bigint").alias("n_marks"),
    )
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_stutter"]
    out = out.select(
        *cols, "n_symbols", "n_upper", "n_marks",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.aggregate(F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: (a == b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("bigint"))).alias("n_stutter"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"),
    )
    # hashes of windows of 2, 4 and 8 words, each from two of half the length
    for half in (1, 2, 4):
        n = F.size("_h") - half
        out = out.withColumn("_h", F.zip_with(F.slice("_h", 1, n), F.slice("_h", half + 1, n), lambda a, b: F.xxhash64(a, b)))
    out = out.select(*names, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"))  # most texts repeat no window
    out = out.select(*names, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_s"))
    again = F.filter("_s", lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) | (x["h"] == F.get("_s", k + 1)["h"]))
    out = out.select(*names, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_p"))
    gaps = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)
    return out.select(*names, F.when(F.col("_p").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction; each condition is (feature, above, threshold): value > threshold, or <= it."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            x = F.expr(FEATURES[name])
            out = out & ((x > limit) if above else (x <= limit))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule fires: an ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


# cells: (bins, bad in grow part, good in grow part, bad in prune part, good in prune part)
Cell = tuple[tuple[int, ...], int, int, int, int]
Test = tuple[int, bool, int]  # feature, above, bin


def fires(bins: tuple[int, ...], tests: list[Test]) -> bool:
    return all((bins[f] > b) == above for f, above, b in tests)


def grow(cells: list[Cell], n_bins: list[int], most: int) -> list[Test]:
    """Add the test of the highest gain until no good row is left or none gains."""
    tests: list[Test] = []
    while len(tests) < most:
        bad, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not bad or not good:
            break
        now, best = math.log2(bad / (bad + good)), (1e-9, None)
        for f, n in enumerate(n_bins):
            count = [[0, 0] for _ in range(n)]
            for c in cells:
                count[c[0][f]][0] += c[1]
                count[c[0][f]][1] += c[2]
            below = [0, 0]
            for b in range(n - 1):
                below = [below[0] + count[b][0], below[1] + count[b][1]]
                for above, (p, q) in ((False, below), (True, [bad - below[0], good - below[1]])):
                    if p and (gain := p * (math.log2(p / (p + q)) - now)) > best[0]:
                        best = (gain, (f, above, b))
        if best[1] is None:
            break
        tests.append(best[1])
        cells = [c for c in cells if fires(c[0], [best[1]])]
    return tests


def prune(cells: list[Cell], tests: list[Test]) -> tuple[list[Test], float, int]:
    """The beginning of the conjunction that is worth most on the prune part, with its precision there and
    the bad rows that it covers."""
    best = (-2.0, 0, [], 0.0, 0)
    for k in range(1, len(tests) + 1):
        own = [c for c in cells if fires(c[0], tests[:k])]
        p, q = sum(c[3] for c in own), sum(c[4] for c in own)
        best = max(best, ((p - q) / max(1, p + q), -k, tests[:k], p / max(1, p + q), p))
    return best[2], best[3], best[4]


def cover(cells: list[Cell], n_bins: list[int], *, max_rules: int, max_conditions: int, precision: float, least: int) -> list[list[Test]]:
    rules = []
    while len(rules) < max_rules:
        tests, right, bad = prune(cells, grow(cells, n_bins, max_conditions))
        if not tests or right < precision or bad < least:
            break
        rules.append(tests)
        cells = [c for c in cells if not fires(c[0], tests)]
    return rules


def learn_rules(statistics: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 8000, bins: int = 24, max_rules: int = 10, max_conditions: int = 4, precision: float = 0.9, least: int = 2) -> list[Rule]:
    """Learn which statistics mark label 0 from at most ``max_rows`` labelled rows (the bound), those with the
    least hash of their id; rows that fail the base rule need no further rule and are left out."""
    ids = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).groupBy("_id").agg(F.min("_y").alias("_y"))
    ids = ids.withColumn("_o", F.xxhash64("_id")).orderBy("_o", "_id").limit(max_rows)
    own = statistics.where(~base_failed()).select(F.col(id_col).alias("_id"), *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    names = list(FEATURES)
    rows = own.join(F.broadcast(ids), "_id")  # at most max_rows ids
    # of rows that share an id the least
    rows = rows.groupBy("_id", "_y", "_o").agg(F.min(F.struct(*names)).alias("_m")).select("_id", "_y", "_o", "_m.*")
    # cuts lie between neighbours among the quantiles of both classes, so that the tail of a small class has its own
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    cuts = rows.groupBy("_y").agg(*[F.percentile(F.col(n), shares).alias(n) for n in names]).collect()
    if len(cuts) < 2:
        return []
    values = {n: sorted({v for r in cuts for v in r[n]}) for n in names}
    edges = {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in values.items()}
    bin_of = [sum((F.col(n) > e).cast("int") for e in edges[n]) + F.lit(0) for n in names]
    part = F.pmod("_o", F.lit(3)) == 0
    counts = [F.count_if(F.col("_y").eqNullSafe(y) & p) for p in (~part, part) for y in (0, 1)]
    found = rows.groupBy(*[b.alias(n) for b, n in zip(bin_of, names, strict=True)]).agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).collect()
    cells = sorted((tuple(r[n] for n in names), r["c0"], r["c1"], r["c2"], r["c3"]) for r in found)
    rules = cover(cells, [len(edges[n]) + 1 for n in names], max_rules=max_rules, max_conditions=max_conditions, precision=precision, least=least)
    return [Rule(tuple((names[f], above, edges[names[f]][b]) for f, above, b in tests)) for tests in rules]


def judged(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with ``base_failed`` and ``kept``."""
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


#: The base statistics by rows of words and of windows.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) > 8),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(8) r(j) GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""
