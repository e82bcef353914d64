"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded with a public tokenizer whose file is a parameter, and only their lengths leave
the workers.  The histogram (rows per length) is exact; sums over it from the long end answer totals,
quantiles and truncated totals for every context limit at once.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram.
Repeated rows count each time, extra columns are ignored; text that spells a special token is
ordinary text; runs of white space, letters or marks of any length count as the tokenizer's pattern cuts them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before byte pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: white space as the tokenizer's pattern means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts with a run of one kind of so many characters are cut to pieces here: the tokenizer's own matcher fails on very
#: long ones.
LONG_RUN = 20_000
#: Lengths of one block of the two-step suffix sums.
BLOCK = 512

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of the file, read once in each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@lru_cache(maxsize=1)
def _patterns() -> tuple:
    import regex

    kinds = (rf"[{WHITE}]", r"\p{L}", r"\p{N}", rf"[^{WHITE}\p{{L}}\p{{N}}]")
    own = PATTERN.replace(r"[^\s\p", rf"[^{WHITE}\p").replace(r"(?!\S)", rf"(?![^{WHITE}])").replace(r"\s+", rf"[{WHITE}]+")
    return regex.compile("|".join(f"{k}{{{LONG_RUN},}}+" for k in kinds)), regex.compile(own)


def token_count(text: str, vocabulary: str) -> int:
    """Tokens of a text of any kind: one with very long runs is cut to the same pieces here, and each is encoded."""
    own = encoding(vocabulary)
    if len(text) >= LONG_RUN:
        long_run, piece = _patterns()
        if long_run.search(text):
            return sum(len(own._encode_single_piece(m[0])) for m in piece.finditer(text))
    return len(own.encode_ordinary(text))


def token_lengths(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: the ``keep`` columns and ``n_tokens``."""
    small_batches(docs.sparkSession)
    cols = list(keep)
    kept = docs.select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.drop("_text").dtypes] + ["n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [token_count(t, vocabulary) for t in texts(b.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(n, pa.int64())], [*cols, "n_tokens"])

    return kept.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Rows of each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram: documents and tokens of length at least L, the share of documents up to L,
    and the tokens that remain when every document is cut at L.

    Sums run within blocks of lengths, and over one row per block, so no task holds the histogram."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(longer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("docs_ge", F.sum("n_docs").over(within)).withColumn("tokens_ge", F.sum("tokens").over(within)).join(blocks, "block")
    h = h.withColumn("docs_ge", F.col("docs_ge") + F.col("docs_after")).withColumn("tokens_ge", F.col("tokens_ge") + F.col("tokens_after"))
    return h.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    below = sums.where(F.col("n_tokens") < limit).agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    longer = sums.where(F.col("n_tokens") >= limit).agg(F.max("docs_ge")).first()[0] or 0
    return below + limit * longer


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents does not exceed."""
    return sums.where(F.col("docs_share") >= q).agg(F.min("n_tokens")).first()[0]
