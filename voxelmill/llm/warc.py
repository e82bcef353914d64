"""WARC archives: written by Spark's text writer, read back by boundary chains.

Each page becomes a record; a page whose payload an earlier page has already is a ``revisit`` of that
page's ``response``.  A partition becomes one archive file.

Reading splits files at the magic of a record's first line, so any split of any file can be read by
its own task; each piece is a candidate record and names the offset of its successor from its header's
Content-Length.  Payloads may hold the magic too.  Only candidates that can be reached from the file's
start along successors are records: chains of neighbours are contracted first, then pointers jump,
doubling their reach each round.  Pieces of a record that its payload's magic cut are joined again.

Defined results: a null payload is empty; records of less than ``min_bytes`` are all responses; a null
page id is written as an empty one, comes last among equals and reads back as null; repeated page ids
are records each; an empty table writes archives without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
URN = "urn:voxelmill:page:"
#: Records of one archive file at most.
FILE_RECORDS = 200_000

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary data: five hex digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write the pages' records below ``path``."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    # who revisits whom, without the payloads; a digest of any number of pages is one partial minimum a task
    compact = stored(rows.where(F.col("bytes") >= min_bytes).select("id", "digest", "bytes"), "warc-digests")
    first = compact.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    first = stored(first, "warc-first")  # a table, so that the pages of one common payload can be dealt to many tasks
    revisits = compact.join(first, ["digest", "bytes"]).where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    revisits = stored(revisits.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first"), "warc-revisits")
    # its size is known from its files: Spark broadcasts it only if it is small
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("first").isNull(), F.concat(http, F.col("payload"))).otherwise(F.lit(""))
    lines = F.concat(
        F.lit(MAGIC),
        F.when(F.col("first").isNull(), F.lit("WARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\n")).otherwise(
            F.concat(F.lit(f"WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{URN}"), text("first"), F.lit(">\r\n"))
        ),
        F.lit(f"WARC-Record-ID: <{URN}"), text("id"), F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Length: "), F.octet_length(F.col("block")).cast("string"), F.lit(END), F.col("block"),
    )
    rows.withColumn("block", block).select(lines.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("_head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _parsed(pieces: DataFrame) -> DataFrame:
    """What the header of ``value`` says, and size and digest of the payload that follows; ``head`` is the
    header's bytes, ``length`` its Content-Length (null: no header), ``whole`` whether all of it is there."""
    p = pieces.withColumn("_head", F.substring_index("value", END, 1))
    p = p.withColumn("head", F.octet_length("_head").cast("bigint")).withColumn("size", F.octet_length("value").cast("bigint"))
    declared = F.expr(r"try_cast(regexp_extract(_head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]{1,18})[ \\t]*(?:\\r\\n|$)', 1) AS bigint)")
    p = p.withColumn("kind", _field("WARC-Type")).withColumn("length", F.when((F.col("head") + 4 <= F.col("size")) & (F.col("kind") != ""), declared))
    p = p.withColumn("whole", F.col("head") + 4 + F.col("length") <= F.col("size"))
    block = F.when(F.col("whole"), F.substring(F.col("value").cast("binary"), (F.col("head") + 5).cast("int"), F.col("length").cast("int")))
    p = p.withColumn("_block", block)
    p = p.withColumn("_payload", F.substring("_block", F.octet_length(F.substring_index(F.col("_block").cast("string"), END, 1)) + 5, F.col("length").cast("int")))
    urn = lambda name: F.regexp_extract(_field(name), f"<{URN}(.*)>", 1)
    return p.select(
        *[c for c in pieces.columns if c != "value"], "size", "head", "kind", "length", "whole",
        urn("WARC-Record-ID").alias("id"), urn("WARC-Refers-To").alias("refers"), _field("WARC-Target-URI").alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("said_digest"), F.expr("try_cast(regexp_extract(_head, '(?i)X-Payload-Length:[ \\\\t]*([0-9]+)', 1) AS bigint)").alias("said_bytes"),
        F.octet_length("_payload").cast("bigint").alias("bytes"), base32_sha1(F.col("_payload")).alias("digest"),
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at each magic: file, split (its start) and row (its order within the split)."""
    df = spark.read.option("lineSep", MAGIC).text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def reachable(links: DataFrame) -> DataFrame:
    """``links``: file, off, next, with an off of 0 where a file starts.  The rows that can be reached from the
    start of their file, by pointer jumping: each round doubles the reach."""
    spark = links.sparkSession
    ptr = links.select("file", "off", "next", (F.col("off") == 0).alias("hit"))
    hits = -1
    while True:
        ptr = stored(ptr, "warc-pointers")
        now = ptr.where("hit").count()
        if now == hits:
            return ptr.where("hit").select("file", "off")
        hits = now
        ahead = ptr.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        reached = ptr.where("hit").select("file", F.col("next").alias("off")).distinct().withColumn("new", F.lit(True))
        ptr = ptr.join(ahead, ["file", "next"], "left").join(reached, ["file", "off"], "left")
        ptr = ptr.select("file", "off", F.coalesce("far", F.lit(-1)).alias("next"), (F.col("hit") | F.coalesce("new", F.lit(False))).alias("hit"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: file, offset, record_type, id, url, refers_to (strings; empty if not there),
    payload_bytes, payload_digest.  Size and digest of a response are those of the payload read; a
    revisit has no payload, so its header's count."""
    pieces = _pieces(spark, path)
    delim = len(MAGIC)
    found = stored(_parsed(pieces), "warc-candidates")
    split = Window.partitionBy("file", "split").orderBy("row")
    rows = found.withColumn("local", F.coalesce(F.sum(F.col("size") + delim).over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = found.groupBy("file", "split").agg(F.sum(F.col("size") + delim).alias("total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(totals, ["file", "split"]).withColumn("off", F.col("base") + F.col("local") - delim).where(F.col("off") >= 0)
    # what comes before a file's first magic is no candidate, and a file that starts otherwise has no record
    rows = rows.withColumn("next", F.when(F.col("length").isNotNull(), F.col("off") + delim + F.col("head") + 4 + F.col("length") + 4))
    rows = stored(rows.drop("local", "base"), "warc-offsets")
    # contraction: a candidate that its neighbour before names, and no other does, belongs to the neighbour's run
    order = Window.partitionBy("file", "split").orderBy("off")
    links = rows.where(F.col("next").isNotNull()).select("file", "split", "off", "next")
    links = links.withColumn("before", F.lag("next").over(order)).withColumn("after", F.lead("off").over(order))
    jumps = links.where(~F.col("next").eqNullSafe(F.col("after"))).select("file", F.col("next").alias("off")).distinct().withColumn("jumped", F.lit(True))
    links = links.join(jumps, ["file", "off"], "left")
    head = F.when(F.col("before").eqNullSafe(F.col("off")) & F.col("jumped").isNull(), F.lit(None)).otherwise(F.col("off"))
    links = stored(links.withColumn("run", F.last(head, ignorenulls=True).over(order)).select("file", "split", "off", "next", "run"), "warc-links")
    runs = links.groupBy("file", "run").agg(F.max_by("next", "off").alias("next"))
    kept = reachable(runs.select("file", F.col("run").alias("off"), "next"))
    real = links.join(kept.select("file", F.col("off").alias("run")), ["file", "run"]).select("file", "off")
    records = stored(rows.join(real, ["file", "off"]), "warc-records")
    columns = ["file", "off", "kind", "id", "url", "refers", "said_digest", "said_bytes", "bytes", "digest"]
    out = records.where("whole").select(*columns)
    if not records.where("NOT whole").isEmpty():
        out = out.unionByName(_joined(pieces, rows, records).select(*columns))
    here = F.col("kind") != "revisit"
    return out.select(
        "file", F.col("off").alias("offset"), F.col("kind").alias("record_type"), "id", "url", F.col("refers").alias("refers_to"),
        F.when(here, F.col("bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"), F.when(here, F.col("digest")).otherwise(F.col("said_digest")).alias("payload_digest"),
    )


def _joined(pieces: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """Records that were cut by a magic in their payload, from their pieces."""
    marks = rows.select("file", "split", "row", "off", "size").join(records.select("file", "off", F.col("next").alias("till"), "whole"), ["file", "off"], "left")
    order = Window.partitionBy("file").orderBy("off")
    record = F.last(F.when(F.col("till").isNotNull(), F.struct("off", "till", "whole")), ignorenulls=True).over(order)
    marks = marks.withColumn("r", record).where(~F.col("r.whole") & (F.col("off") < F.col("r.till"))).select("file", "split", "row", "off", "size", F.col("r.off").alias("record"))
    # a second scan must cut the files alike; sizes tell, and another cut is an error
    parts = pieces.join(stored(marks, "warc-cut"), ["file", "split", "row"])
    alike = F.octet_length("value") == F.col("size")
    parts = parts.withColumn("value", F.when(alike, F.col("value")).otherwise(F.raise_error(F.lit("the archives were split in another way on the second scan"))))
    whole = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("v"))
    value = F.array_join(F.transform("v", lambda x: x["value"]), MAGIC)
    return _parsed(whole.select("file", F.col("record").alias("off"), value.alias("value")))


def page_digests(records: DataFrame, id_type: str) -> DataFrame:
    """One row per record, with page ids in their own type."""
    own = lambda c: F.expr(f"try_cast(nullif({c}, '') AS {id_type})")
    return records.select(own("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", own("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 5 * CAST(i // 4 AS INTEGER) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS digest FROM s),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f"""
