"""Site-relative line dedup: drop lines that too many pages of one host carry.

For each host, the pages containing a line are divided by the host's pages;
lines on at least ``min_pages`` pages and on more than ``max_ratio`` of them are
boilerplate and dropped from every page of that host. A line is compared
without spaces at either end; lines that are empty then always stay.

Only DataFrame functions run here. Lines are counted as (host, hash of line)
with a map-side partial count, so neither a host with a third of all pages nor a
line on all of them meets in one task. Copies of a page are one page: a host's distinct whole texts are counted
(``copies_once=False`` counts every row). The lines to drop number at most
``lines per page / max_ratio`` a host; up to ``broadcast_lines`` of them (a
checked count) are sent to all executors, beyond that pages and lists meet by a
shuffle.

Edge cases: null text stays null and counts as a page without lines; a null
host is a host of its own; a line repeated on one page counts once; repeated
rows of a host count as one page and each lose the line; an empty table gives an empty result; a very long text is a row as any other; other
columns pass through whatever their names, except that ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.llm.store import saved

BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits of a trimmed line; null for an empty one."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(line != "", F.struct(F.xxhash64(line).alias("h"), F.crc32(line).alias("c")))


def boilerplate_lines(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 3, copies_once: bool = True
) -> DataFrame:
    """host, key, pages, ratio of each line to drop; with ``copies_once`` a host's pages of one whole text are one page."""
    keys = F.filter(F.array_distinct(F.transform(_lines(F.col(text)), _key)), lambda k: k.isNotNull())
    pages = pages.select(F.col(host).alias("host"), keys.alias("keys"), F.xxhash64(text).alias("h"), F.crc32(text).alias("c"))
    if copies_once:
        pages = pages.groupBy("host", "h", "c").agg(F.first("keys").alias("keys"))
    counts = (
        pages.select("host", F.explode("keys").alias("key"))
        .groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    )
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("all_pages"))
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .withColumn("ratio", F.col("pages") / F.col("all_pages"))
        .filter(F.col("ratio") > max_ratio).select("host", "key", "pages", "ratio")
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 3, broadcast_lines: int = 100_000, copies_once: bool = True
) -> DataFrame:
    """The pages with their remaining text, ``n_lines`` and ``n_dropped`` (long)."""
    found = saved(boilerplate_lines(pages, host, text, max_ratio, min_pages, copies_once), "boilerplate")
    named = {c.lower() for c in pages.columns}
    of, drop, left = (next(x for x in (name + "_" * k for k in range(len(named) + 1)) if x not in named) for name in ("_host", "_drop", "_kept"))
    per_host = found.groupBy(F.col("host").alias(of)).agg(F.collect_list("key").alias(drop))
    if found.count() <= broadcast_lines:
        per_host = F.broadcast(per_host)
    marked = pages.join(per_host, F.col(host).eqNullSafe(F.col(of)), "left")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)))
    return (
        marked.withColumn(left, F.when(F.col(drop).isNotNull(), kept).otherwise(_lines(F.col(text))))
        .withColumn("n_lines", F.coalesce(F.size(_lines(F.col(text))), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.coalesce(F.size(left), F.lit(0)))
        .withColumn(text, F.array_join(left, "\n"))
        .drop(of, drop, left)
    )


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, source, unnest(list_distinct([x for x in [trim(y, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) for y in string_split(text, chr(10))] if x <> ''])) AS line
  FROM (SELECT min(doc_id) AS doc_id, source, text FROM documents GROUP BY source, text)),
t AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
bad AS (
  SELECT l.source, list(l.line) AS lines
  FROM (SELECT source, line, count(*) AS n FROM l GROUP BY source, line HAVING count(*) >= 3) l
  JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n::DOUBLE / t.n > 0.05 GROUP BY l.source),
k AS (
  SELECT d.*, string_split(text, chr(10)) AS parts,
         [y for y in string_split(text, chr(10)) if NOT list_contains(coalesce(bad.lines, []), trim(y, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))] AS kept
  FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, (coalesce(len(parts), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""
