"""Merkle fixity audit of WARC archives.

``warc_records`` turns pages into WARC response records. An archive is a run of ``ARCHIVE`` record numbers; its leaves
hold a record's digest, offset and length, and every node above hashes its ordered children: number, digest, and the range of offsets
each takes up from the node's own start. A lost or longer record so shows in its own branch and in no other.
``audit`` compares the archive roots of two replicas and descends only below mismatching nodes. Each level is a table of its own, and
a level is read only for the nodes whose parents differ.

Edge cases: null url or html count as empty; records without a page_id share the lowest record number; repeated page
ids share a leaf, whose digest covers the number of records and sums of their digests, so no order and no list is needed; a record on one side only is
``missing`` or ``extra``; equal trees and empty tables give no rows; very long pages are one record; other
columns are ignored, whatever their names. Every node has at most ``FAN`` children, and offsets are
summed over the leaves of one archive, so no task grows with the input. Sparse page ids make archives of few records;
number pages densely where roots should stand for many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.llm.store import saved

BITS = 4
FAN = 1 << BITS
DEPTH = 3
ARCHIVE = FAN**DEPTH
NO_NUMBER = -(1 << 63)
#: Pages carry no capture time; records get this one unless told another.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_record(url: Column, html: Column, date: str = NO_DATE) -> Column:
    """The bytes of a WARC 1.1 response record, as text: its block is an HTTP response with the page as body."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    identity = F.regexp_replace(F.md5(F.concat(url, F.lit("\n"), html)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), identity, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )


def warc_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """archive, number, length, digest: one row a record."""
    rows = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_NUMBER)).alias("number"), warc_record(F.col("url"), F.col("html")).alias("record"))
    return rows.select(
        F.shiftright("number", BITS * DEPTH).alias("archive"), "number", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")
    )


def leaves(records: DataFrame) -> DataFrame:
    """archive, number, offset (in the archive), length, digest: one row for each record number."""
    pieces = [F.sum(F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    several = F.sha2(F.concat_ws("+", F.count(F.lit(1)).cast("string"), *pieces), 256)
    leaf = records.groupBy("archive", "number").agg(F.when(F.count(F.lit(1)) == 1, F.min("digest")).otherwise(several).alias("digest"), F.sum("length").alias("length"))
    ahead = W.partitionBy("archive").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    return leaf.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))


def _folded(children: DataFrame) -> DataFrame:
    """Nodes over FAN neighbouring children each; a node's number is the first record number's place at its level."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "offset", "length", "digest")))
    told = F.transform(ordered, lambda x: F.concat_ws(":", x["number"].cast("string"), (x["offset"] - ordered[0]["offset"]).cast("string"), x["length"].cast("string"), x["digest"]))
    return (
        children.groupBy("archive", F.shiftright("number", BITS).alias("node"))
        .agg(F.sha2(F.array_join(told, "\n"), 256).alias("digest"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
        .withColumnRenamed("node", "number")
    )


def merkle_nodes(records: DataFrame, name: str = "merkle") -> list[DataFrame]:
    """Levels 0 (leaves: digest of the record bytes) to DEPTH (archive roots), each saved."""
    levels = [saved(leaves(records), f"{name}-0")]
    for level in range(1, DEPTH + 1):
        levels.append(saved(_folded(levels[-1]), f"{name}-{level}"))
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, number, kind (altered, missing, extra), offset and length (in left, if there): the records in which right differs from left."""
    pair = merkle_nodes(left, "merkle-left"), merkle_nodes(right, "merkle-right")
    suspects = None
    for level in range(DEPTH, -1, -1):
        a, b = (x[level].select("archive", "number", *[F.col(c).alias(f"{c}_{k}") for c in ("digest", "offset", "length")]) for k, x in enumerate(pair))
        if suspects is not None:
            a, b = (x.withColumn("parent", F.shiftright("number", BITS)).join(suspects, ["archive", "parent"], "left_semi").drop("parent") for x in (a, b))
        differ = ~F.col("digest_0").eqNullSafe(F.col("digest_1"))
        found = saved(a.join(b, ["archive", "number"], "full").filter(differ), "merkle-differs")
        suspects = found.select("archive", F.col("number").alias("parent"))
    kind = F.when(F.col("digest_1").isNull(), "missing").when(F.col("digest_0").isNull(), "extra").otherwise("altered")
    return found.select(
        "archive", "number", kind.alias("kind"), F.coalesce("offset_0", "offset_1").alias("offset"), F.coalesce("length_0", "length_1").alias("length")
    )


#: Compares the two replicas record by record. Tables in which page ids are null or repeat aren't covered.
ORACLE_SQL = """
WITH replica AS (
  SELECT page_id, url, CASE WHEN page_id % 37 = 5 THEN '?' || substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % 101 <> 7),
b AS (
  SELECT page_id AS number, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS m,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
         || octet_length(encode(coalesce(html, '')))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS block
  FROM pages),
r AS (
  SELECT number, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
         || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>'
         || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
         || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(block))::VARCHAR
         || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM b),
o AS (
  SELECT number, html, number // 4096 AS archive, octet_length(encode(record))::BIGINT AS length FROM r),
p AS (
  SELECT *, (sum(length) OVER (PARTITION BY archive ORDER BY number ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM o)
SELECT archive, number, CASE WHEN x.page_id IS NULL THEN 'missing' ELSE 'altered' END AS kind, "offset", length
FROM p LEFT JOIN replica x ON x.page_id = p.number
WHERE x.page_id IS NULL OR coalesce(x.html, '') <> p.html
"""
