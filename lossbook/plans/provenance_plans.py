"""Queries of where values come from, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import provenance
from lossbook.plans import dialect as d
from lossbook.plans.notice_plans import BODY
from lossbook.sources.adapters import load, oracle_with

VALUES = {
    "policy.policy_number": "policy_number", "policy.insured_name": "insured_name", "loss.loss_location": "loss_location", "loss.cause_of_loss": "cause_of_loss",
    "loss.loss_description": "loss_description", "notification.reporter_organisation": "reporter_organisation", "additional.police_reference": "police_reference",
}


def _case_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of the cases; their notices (source 0), cover letters (1) and the documents that came with them (2 to 5)."""
    cases = load(spark, sf_dir, "cases")
    values = cases.select("case_id", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).alias("value")) for p, c in VALUES.items()])))
    own = F.array(*[F.struct(F.lit(k).alias("source"), F.expr(t).alias("text")) for k, t in enumerate((BODY, "concat_ws(' ', source_body, affected_assets, cause_of_loss)"))])
    texts = cases.select("case_id", F.inline(own))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id div 4 AS case_id", "CAST(2 + doc_id % 4 AS INT) AS source", "text")
    return values, texts.unionByName(documents)


def field_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.field_provenance(*_case_texts(spark, sf_dir))


def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.evidence_edges(*_case_texts(spark, sf_dir))


_TEXTS = oracle_with("cases") + f""",
v AS (SELECT case_id, x.p AS path, {d.words("x.v")} AS w FROM (SELECT case_id, unnest([{", ".join(f"{{'p': '{p}', 'v': {c}}}" for p, c in VALUES.items())}]) AS x FROM cases)),
t AS (SELECT case_id, source, {d.words("text")} AS tw FROM (
  SELECT case_id, 0 AS source, {BODY} AS text FROM cases UNION ALL SELECT case_id, 1, concat_ws(' ', source_body, affected_assets, cause_of_loss) FROM cases
  UNION ALL SELECT doc_id // 4, (2 + doc_id % 4)::INT, text FROM documents)),
m AS (SELECT v.case_id, path, w, source, tw, ' ' || array_to_string(tw, ' ') || ' ' AS line FROM v JOIN t ON v.case_id = t.case_id AND list_has_any(v.w, t.tw))"""
ORACLES = {
    "field_provenance": _TEXTS + f""",
parts AS (SELECT * EXCLUDE (line), ' ' || array_to_string(w[i + 1:i + n], ' ') || ' ' AS part, line FROM m, LATERAL (SELECT unnest(range(len(w))) AS i), LATERAL (SELECT unnest(range(1, len(w) - i + 1)) AS n)),
hit AS (SELECT *, len(string_split(left(line, instr(line, part)), ' ')) - 2 AS place FROM parts WHERE contains(line, part)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY case_id, path ORDER BY n DESC, source, place, i) = 1)
SELECT case_id, path, source, place::INT AS place, n::INT AS length, n = len(w) AS whole,
  array_to_string(tw[greatest(place - {provenance.AROUND}, 0) + 1:place + n + {provenance.AROUND}], ' ') AS excerpt FROM best""",
    "evidence_edges": _TEXTS + """
SELECT DISTINCT case_id, 'document:' || case_id::VARCHAR || '/' || source::VARCHAR AS src, 'EVIDENCES' AS rel, 'field:' || case_id::VARCHAR || '/' || path AS dst
FROM m WHERE len(w) > 0 AND contains(line, ' ' || array_to_string(w, ' ') || ' ')""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
