"""Mixing sources to target weights with pivotal rounding, in DataFrame operations only.

Every document of a source should be taken c = target / source size times.  The whole part is fixed;
the fractional parts are rounded by a pivotal method on words: two documents exchange mass at random,
what one gains in words the other loses, until one of them is integral; the other, the residual, meets
the next (large ones first, so that what remains is small).  Buckets of documents reduce to one residual each, buckets of residuals again, a tree whose
nodes are as many tasks as wanted.  The words taken of a source so stay at its target but for the last
residual, a part of one document.

Defined results: null texts have size 0; documents of size 0 are taken 0 words; a null source is a
source of its own, last in order; empty tables give no rows.  Repeated rows are documents of their
own.  All choices hash ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents or residuals that one node of the tree reduces, on average.
FAN_IN = 64

_uniform = "(pmod(xxhash64({0}), 1048576) + 0.5) / 1048576"


def source_targets(sized: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: source_size and target; the targets share all words by weight, none above ``most`` times
    its source's size, and what that cuts off is shared again by weight.

    With the sources in order of cap / weight, the first whose share fits ends the capping: prefix sums
    over one row per source find it without a loop."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _duels(id_type: str, seed: int) -> str:
    """SQL that folds ``items`` (id, size, p) pair by pair; gives the last residual and the rounded ones."""
    give = f"named_struct('id', {{0}}.id, 'bit', {{1}})"
    left = "named_struct('id', {0}.id, 'size', {0}.size, 'p', {1}, 'done', array_append(a.done, {2}))"
    # in units of a's probability: how far it can rise and fall
    up, down = "least(1 - a.p, x.p * x.size / a.size)", "least(a.p, (1 - x.p) * x.size / a.size)"
    u = _uniform.format(f"a.id, x.id, {seed}L")
    duel = f"""
      CASE WHEN {u} * ({up} + {down}) < {down} THEN
        CASE WHEN (1 - a.p) * a.size <= x.p * x.size
             THEN {left.format("x", "greatest(0D, x.p - (1 - a.p) * a.size / x.size)", give.format("a", 1))}
             ELSE {left.format("a", "least(1D, a.p + x.p * x.size / a.size)", give.format("x", 0))} END
      ELSE
        CASE WHEN a.p * a.size <= (1 - x.p) * x.size
             THEN {left.format("x", "least(1D, x.p + a.p * a.size / x.size)", give.format("a", 0))}
             ELSE {left.format("a", "greatest(0D, a.p - (1 - x.p) * x.size / a.size)", give.format("x", 1))} END
      END"""
    none = f"CAST(array() AS array<struct<id:{id_type},bit:int>>)"
    first = f"named_struct('id', items[0].id, 'size', items[0].size, 'p', items[0].p, 'done', {none})"
    return f"aggregate(slice(items, 2, size(items)), {first}, (a, x) -> {duel})"


def round_copies(parts: DataFrame, *, seed: int = 1) -> DataFrame:
    """``parts``: group, id (unique), size > 0, p strictly between 0 and 1; read three times, so it should come from a
    table by cheap steps.  Gives id and bit (0 or 1): in each group the sum of size * bit is that of size * p but for a
    part of one row."""
    id_type = dict(parts.dtypes)["id"]
    counts = parts.groupBy("group").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return parts.select("id", F.lit(0).alias("bit"))
    rows = parts.join(counts.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    done, level = [], 0
    while True:
        nodes = F.ceil(F.col("n") / FAN_IN)
        key = F.xxhash64("id", F.lit(seed + level))
        rows = rows.withColumn("n", nodes).withColumn("h", key).withColumn("bucket", F.pmod(F.col("h"), F.col("n")))
        found = rows.groupBy("group", "n", "bucket").agg(F.sort_array(F.collect_list(F.struct("size", "h", "id", "p")), asc=False).alias("items"))
        found = stored(found.select("group", "n", F.expr(_duels(id_type, seed)).alias("a")), f"mix-level{level}")
        done.append(found.select(F.explode("a.done").alias("d")).select("d.id", "d.bit"))
        rest = found.select("group", "n", "a.id", "a.size", "a.p")
        most, level = math_ceil(most, FAN_IN), level + 1
        if most == 1:
            done.append(rest.select("id", F.when(F.expr(_uniform.format(f"id, {seed}L")) < F.col("p"), 1).otherwise(0).alias("bit")))
            break
        rows = rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def math_ceil(a: int, b: int) -> int:
    return -(-a // b)


def document_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE, -1), ""))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.cast("bigint").alias("size"), *keep)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> DataFrame:
    """Per row: the id (under ``id_col``), size, source_size, target and taken (words, repeats counted)."""
    sized = document_sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    again = Window.partitionBy("id").orderBy("size", "source")  # repeated ids get numbers
    sized = stored(sized.withColumn("copy", F.row_number().over(again)), "mix-sizes")
    targets = stored(source_targets(sized, weights=weights, most=most).withColumnRenamed("source", "_s"), "mix-targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("p", F.col("copies") - F.floor("copies")).withColumn("key", F.struct("id", "copy"))
    parts = rows.where((F.col("size") > 0) & (F.col("p") > 0)).select(F.col("source").alias("group"), F.col("key").alias("id"), F.col("size").cast("double").alias("size"), "p")
    bits = round_copies(parts, seed=seed).select(F.col("id.id").alias("_i"), F.col("id.copy").alias("_c"), "bit")
    out = rows.join(bits, F.col("id").eqNullSafe(F.col("_i")) & (F.col("copy") == F.col("_c")), "left")
    taken = (F.col("size") * (F.floor("copies") + F.coalesce("bit", F.lit(0)))).cast("bigint")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


#: Targets by rounds: share what is left, cap, share again, until none is above its cap.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE "BINARY" NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
total AS (SELECT sum(source_size) AS words FROM s),
rounds(k, level) AS (SELECT 0, words / (SELECT sum(w) FROM s) FROM total
  UNION ALL SELECT k + 1, (words - (SELECT coalesce(sum(3.0 * source_size), 0) FROM s WHERE w * level > 3.0 * source_size)) / (SELECT sum(w) FROM s WHERE w * level <= 3.0 * source_size) FROM rounds, total WHERE k < 60 AND EXISTS (SELECT 1 FROM s WHERE w * level <= 3.0 * source_size)),
last AS (SELECT level FROM rounds WHERE level IS NOT NULL ORDER BY k DESC LIMIT 1)
SELECT source, source_size, round(CAST(least(3.0 * source_size, w * level) AS DOUBLE), 3) AS target FROM s, last"""
