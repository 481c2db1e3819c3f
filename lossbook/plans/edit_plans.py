"""Queries of the edit log, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import edits
from lossbook.sources.adapters import load, oracle_with

AS_OF = "1996-06-01 12:00:00"
#: What the cases say before any edit, field by field.
INITIAL = {
    "loss.injuries": "CAST(injuries AS STRING)", "financial.estimated_loss": "CAST(estimated_loss_minor AS STRING)", "loss.loss_country": "loss_country",
    "loss.structural_damage": "CASE WHEN structural_damage THEN 'true' ELSE 'false' END", "notification.reporter_email": "lower(reporter_email)",
}


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = F.array(*[F.struct(F.lit(path).alias("path"), F.expr(value).alias("value")) for path, value in INITIAL.items()])
    initial = load(spark, sf_dir, "cases").select("case_id", F.inline(table))
    converted = load(spark, sf_dir, "claims").select(F.col("claim_id").alias("case_id"), (F.col("reported_at") + F.expr("interval '60' day")).alias("converted_at"))
    return initial, edits.read_edits(load(spark, sf_dir, "edits"), converted)


def edits_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)[1].filter("refused is not null").select("change_id", "case_id", "path", "raw", "refused")


def case_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.state_as_of(*_log(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))


def audit_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.audit_diffs(*_log(spark, sf_dir)).withColumn("nth", F.col("nth").cast("int"))


_LOG = oracle_with("cases", "claims", "edits") + f""",
initial AS (SELECT case_id, x.path AS path, x.value AS value FROM (SELECT case_id, unnest([{", ".join(f"{{'path': '{p}', 'value': {v}}}" for p, v in INITIAL.items())}]) AS x FROM cases)),
once AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY moment, case_id, path, raw NULLS FIRST, actor, reason NULLS FIRST) = 1),
e AS (SELECT edits.*, trim(raw) AS t, moment >= c.reported_at + INTERVAL 60 DAY AS late FROM once AS edits LEFT JOIN claims c ON c.claim_id = edits.case_id),
v AS (SELECT *, CASE path WHEN 'loss.injuries' THEN CASE WHEN t = 'none' THEN '0' ELSE regexp_extract(t, '[0-9]+') END
    WHEN 'financial.estimated_loss' THEN CASE WHEN t <> 'much' THEN (regexp_extract(t, '[0-9]+')::BIGINT * 100000)::VARCHAR END
    WHEN 'loss.loss_country' THEN t WHEN 'loss.structural_damage' THEN CASE lower(t) WHEN 'yes' THEN 'true' WHEN 'no' THEN 'false' END
    WHEN 'notification.reporter_email' THEN CASE WHEN contains(t, '@') THEN lower(t) END END AS value FROM e),
w AS (SELECT *, CASE WHEN path = 'policy.limit' THEN 'not_editable' WHEN late THEN 'converted' WHEN coalesce(t, '') = '' THEN CASE WHEN path = 'loss.structural_damage' THEN 'not_readable' END
    WHEN value IS NULL THEN 'not_readable' END AS refused FROM v),
g AS (SELECT change_id, case_id, path, moment, actor, reason, nullif(value, '') AS value, CASE WHEN path = 'financial.estimated_loss' THEN t ELSE nullif(value, '') END AS shown FROM w WHERE refused IS NULL)"""
ORACLES = {
    "edits_refused": _LOG + " SELECT change_id, case_id, path, raw, refused FROM w WHERE refused IS NOT NULL",
    "case_state_as_of": _LOG + f""",
l AS (SELECT case_id, path, value, true AS told FROM g WHERE moment <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY case_id, path ORDER BY moment DESC, change_id DESC) = 1)
SELECT case_id, path, CASE WHEN told THEN l.value ELSE i.value END AS value, coalesce(told, false) AS human_modified, CASE WHEN told THEN i.value END AS original_value
FROM initial i FULL JOIN l USING (case_id, path)""",
    "audit_diffs": _LOG + """,
h AS (SELECT g.*, row_number() OVER o AS k, lag(g.value) OVER o AS last_value, lag(g.shown) OVER o AS last_shown, i.value AS held FROM g LEFT JOIN initial i USING (case_id, path)
  WINDOW o AS (PARTITION BY case_id, path ORDER BY moment, change_id)),
d AS (SELECT *, CASE WHEN k = 1 THEN held ELSE last_value END AS was, CASE WHEN k = 1 THEN held ELSE last_shown END AS was_shown FROM h)
SELECT change_id, case_id, path, moment, actor, reason, was_shown AS before, shown AS after, row_number() OVER (PARTITION BY case_id, path, moment::DATE ORDER BY moment, change_id)::INT AS nth
FROM d WHERE value IS DISTINCT FROM was""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
