"""Queries of stored analyses, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import analyses
from lossbook.sources.adapters import load, oracle_with

#: Results as different versions of the analyses wrote them: whole, without some values, cut off, not there.
COVERAGE = """CASE CAST(case_id % 5 AS INT) WHEN 0 THEN '{"indicator":"likely_covered","reasoning":"ran to ' || CAST(case_id % 99 AS STRING) || '","checks":[{"key":"in_force","label":"In force","state":"pass","detail":"d'
  || CAST(case_id % 7 AS STRING) || '"},{"key":"peril"}]}' WHEN 1 THEN '{"checks":[],"other":' || CAST(case_id AS STRING) || '}' WHEN 2 THEN '{"indicator":"review_required","checks":[7,{"state":"fail","key":"limit"}]}'
  WHEN 3 THEN '{"indicator":"cut' END"""
FRAUD = """CASE WHEN case_id % 4 = 0 THEN '{"level":"high","score":' || CAST(CAST(case_id % 100 AS DOUBLE) / 100 AS STRING) || ',"indicators":[{"code":"late","weight":0.25,"title":"Late"},{"code":"sparse"}]}'
  WHEN case_id % 4 = 1 THEN '{"score":"0.5"}' ELSE '{"level":null}' END"""
EXTRACTION = """CASE WHEN case_id % 3 = 0 THEN '{"loss":{"date_of_loss":{"value":"' || CAST(CAST(received_at AS DATE) AS STRING) || '","confidence":0.9}}}' ELSE '{"loss":{}}' END"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over all notices, and a second over some of them a day later."""
    cases = load(spark, sf_dir, "cases")

    def run(rows: DataFrame, provider: str, days: int) -> DataFrame:
        table = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(r).alias("result")) for k, r in (("coverage", COVERAGE), ("fraud", FRAUD), ("extraction", EXTRACTION))])
        moment = (F.col("received_at") + F.expr(f"interval '{days}' day")).alias("updated_at")
        return rows.select("case_id", F.lit(provider).alias("provider"), (F.col("case_id") % 10 / 10).alias("confidence"), moment, F.inline(table))

    first = analyses.record(None, run(cases, "rules", 0))
    again = run(cases.filter("case_id % 3 = 1"), "model", 1)
    return analyses.record(first, again.withColumn("result", F.when(F.col("kind") == "fraud", F.lit('{"level":"medium","score":0.4}')).otherwise(F.col("result"))))


def analysis_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analyses.coverage(_stored(spark, sf_dir))
    line = F.transform("checks", lambda c: F.concat_ws("|", c["key"], c["label"], c["state"], c["detail"]))
    return got.withColumn("checks", F.array_join(line, ";"))


def fraud_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analyses.fraud(_stored(spark, sf_dir))
    line = F.transform("indicators", lambda i: F.concat_ws("|", i["code"], i["title"], i["detail"], i["weight"].cast("string")))
    return got.withColumn("indicators", F.array_join(line, ";"))


def raw_loss_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.raw_loss_date(_stored(spark, sf_dir))


def _objects(path: str, defaults: dict[str, str]) -> str:
    values = ", ".join(f"coalesce(json_extract_string(x, '$.{n}'), '{v}')" for n, v in defaults.items())
    return f"array_to_string([concat_ws('|', {values}) FOR x IN coalesce(json_extract(j, '{path}[*]'), []) IF json_type(x) = 'OBJECT'], ';')"


_RUNS = oracle_with("cases") + f""",
a AS (SELECT case_id, case_id % 3 = 1 AS again, case_id % 10 / 10.0::DOUBLE AS confidence, received_at, {COVERAGE} AS c, {FRAUD} AS f, {EXTRACTION} AS e FROM cases),
s AS (SELECT *, CASE WHEN again THEN '{{"level":"medium","score":0.4}}' ELSE f END AS f2, CASE WHEN again THEN 'model' ELSE 'rules' END AS provider, received_at + CASE WHEN again THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS updated_at FROM a)"""
ORACLES = {
    "analysis_readback": _RUNS + f""", r AS (SELECT *, CASE WHEN json_valid(c) THEN c::JSON END AS j FROM s)
SELECT case_id, coalesce(json_extract_string(j, '$.indicator'), 'insufficient_information') AS indicator, confidence, coalesce(json_extract_string(j, '$.reasoning'), '') AS reasoning,
  {_objects("$.checks", {"key": "", "label": "", "state": "unknown", "detail": ""})} AS checks, updated_at AS completed_at, provider AS produced_by FROM r""",
    "fraud_readback": _RUNS + f""", r AS (SELECT *, f2::JSON AS j FROM s)
SELECT case_id, coalesce(json_extract_string(j, '$.level'), 'low') AS level, coalesce(json_extract_string(j, '$.score')::DOUBLE, 0) AS score,
  {_objects("$.indicators", {"code": "", "title": "", "detail": "", "weight": "0.0"})} AS indicators FROM r""",
    "raw_loss_dates": _RUNS + " SELECT case_id, json_extract_string(e::JSON, '$.loss.date_of_loss.value') AS raw FROM s",
}
QUERIES = {name: globals()[name] for name in ORACLES}
