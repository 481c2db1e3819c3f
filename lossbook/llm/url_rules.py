"""URL filters: each url judged by the longest of many (host, path) rules that fit it.

A rule fits its host and all subdomains where the url's path starts with the rule's path. Hosts are written label by label from the end
(``www.example.org`` as ``org/example/www/``, as no host holds a slash), so a host with all its subdomains, and a path with all it begins, are
each an interval of keys from the prefix up to the prefix and a byte that no text holds. Intervals of prefixes are nested or apart, and one sweep in key
order answers both: it goes over the points (keys to judge) and over the beginnings and ends of intervals, a beginning pushes its rule on a stack, an end pops it,
and a point takes the top. The first sweep finds the longest rule host of each distinct url; the second finds, for each url under a rule
host and each suffix of that host, the rule with the longest path. Of a url's rules the longest one wins, by length of host and path together, then by its host's.

The sweep is a sort-merge join in DataFrame functions: points and interval bounds are dealt into ranges of the key, an interval that reaches over
several ranges is opened again at the beginning of each (at most as many copies a range as rules nest), and windows over one range each keep the stack as a depth and, for each depth, the last
rule pushed. Points are distinct keys, so neither a host with a third of all urls nor a url with a third of all rows meets in one range. Verdicts go
back to the rows by a join: broadcast up to ``broadcast_urls`` of them (a checked count), else shuffled, where repeated urls are dealt to ``SALTS`` parts.

Edge cases: a null url, or one without ``://``, has an empty host and path; an empty rule host fits empty hosts (and those that end with a dot) only; rules
are compared after lower-casing the A-Z of their hosts; a rule given twice is one, and blocks if one of the two blocks; rules with a null host, path or verdict are none; ports and user names
are part of the host; repeated rows are each judged; an empty table or no rules give every row the default; other columns pass through whatever their names,
except that ``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.llm.store import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict of some rules written out in a program."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows)) if rules else spark.sql("select '' host, '' path, '' verdict where false")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(_labels(host), "/"), F.lit("/"))


def innermost(points: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """The points with ``top``, the payload of the longest rule whose key begins theirs; points without one are left out.

    points: key and a struct ``point``, each point once; rules: key (each once) and payload; keys are strings.
    """
    point_type, payload_type = points.schema["point"].dataType, rules.schema["payload"].dataType
    no_point, no_rule = F.lit(None).cast(point_type), F.lit(None).cast(payload_type)
    key, order = F.col("key").cast("binary"), ("key", "turn", "spread")
    none = F.lit(0).cast("long")
    # one key's turns: ends of what lies before it, beginnings, points
    rows = (
        rules.select(key.alias("key"), F.lit(1).alias("turn"), none.alias("spread"), F.col("key").alias("rule"), "payload", no_point.alias("point"))
        .unionByName(rules.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("turn"), none.alias("spread"), F.col("key").alias("rule"), "payload", no_point.alias("point")))
        .unionByName(points.select(key.alias("key"), F.lit(2).alias("turn"), F.xxhash64("point").alias("spread"), F.lit(None).cast("string").alias("rule"), no_rule.alias("payload"), "point"))
    )
    dealt = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    spans = dealt.filter("turn < 2").groupBy("rule").agg(F.min("range").alias("first"), F.max("range").alias("last"), F.min("key").alias("key"), F.first("payload").alias("payload"))
    again = spans.filter("last > first").select(
        "key", F.lit(1).alias("turn"), none.alias("spread"), "rule", "payload", no_point.alias("point"), F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("range")
    )
    upto = lambda *by: W.partitionBy(*by).orderBy("key", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    pushed = F.col("turn") == 1
    depth = F.sum(F.when(pushed, 1).when(F.col("turn") == 0, -1).otherwise(0)).over(upto("range"))
    top = F.last(F.when(pushed, F.struct("payload")), ignorenulls=True).over(upto("range", "depth"))
    swept = dealt.unionByName(again).withColumn("depth", depth).withColumn("top", top)
    return swept.filter("turn = 2 and depth > 0").select("point", F.col("top.payload").alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_urls: int = 100_000) -> DataFrame:
    """The rows with host, path, rule (host and path of the one that decides, or null) and verdict (the rule's, else ``default``)."""
    rules = (
        rules.filter("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.coalesce(F.max(F.when(F.col("verdict") == "block", F.col("verdict"))), F.min("verdict")).alias("verdict"))
        .withColumn("host_key", host_key(F.col("host")))
    )
    named = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).drop("rule", "verdict")
    urls = named.select("host", "path").distinct().select(host_key(F.col("host")).alias("key"), F.struct("host", "path").alias("point"))
    rule_hosts = rules.select(F.col("host_key").alias("key"), F.col("host_key").alias("payload")).distinct()
    labels = F.split(F.substring("top", F.lit(1), F.length("top") - 1), "/", -1)
    suffix = lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "/"), F.lit("/"))
    # every suffix of the longest rule host may have rules of its own; no host or path holds a question mark
    under = innermost(urls, rule_hosts, "url-hosts").select("point", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), suffix)).alias("above"))
    asked = under.select(F.concat("above", F.lit("?"), "point.path").alias("key"), "point")
    payload = F.struct(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    found = innermost(asked, rules.select(F.concat("host_key", F.lit("?"), "path").alias("key"), payload.alias("payload")), "url-paths")
    size = F.length("top.rule_host") + F.length("top.rule_path")
    best = F.max_by("top", F.struct(size, F.length("top.rule_host")))
    decided = saved(found.groupBy("point").agg(best.alias("best")), "url-verdicts")
    names = {c.lower() for c in named.columns}
    host, path, top = (next(x for x in (n + "_" * k for k in range(len(names) + 1)) if x not in names) for n in ("_host", "_path", "_best"))
    decided = decided.select(F.col("point.host").alias(host), F.col("point.path").alias(path), F.col("best").alias(top))
    if decided.count() <= broadcast_urls:
        decided = F.broadcast(decided)
    judged = named.join(decided, (F.col("host") == F.col(host)) & (F.col("path") == F.col(path)), "left")
    rule = F.concat(F.col(top)["rule_host"], F.col(top)["rule_path"])
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(F.col(top)["verdict"], F.lit(default))).drop(host, path, top)


ORACLE_SQL = """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS row_id, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT row_id, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT s.row_id, arg_max(r.h || r.p, length(r.h || r.p) * 10000 + length(r.h)) AS rule, arg_max(r.v, length(r.h || r.p) * 10000 + length(r.h)) AS verdict
  FROM s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.row_id)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM s LEFT JOIN f USING (row_id)
"""
