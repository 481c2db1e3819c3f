"""Queries of the queue layer and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import merge, queue
from lossbook.plans.dialect import form, quoted
from lossbook.sources.adapters import AS_OF, load, oracle_with
from lossbook.vocab import BLOCKING_CODES, REVIEW_STATUSES

SINCE = "2001-07-01 00:00:00"


def claims_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claims_queue(load(spark, sf_dir, "claims"), AS_OF, statuses=("open", "in_review", "approved"), query="customer", number=2, size=50)


def claims_status_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.status_facets(load(spark, sf_dir, "cases"))


def claims_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claims_tiles(load(spark, sf_dir, "claims"))


def exposure_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.exposure_by_currency(load(spark, sf_dir, "claims"))


def intake_queue_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.intake_queue(load(spark, sf_dir, "cases"), channels=("email", "portal"), needs_review=True, unassigned=True, size=100)


def intake_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.intake_queue(load(spark, sf_dir, "cases"), query="nation_7", size=100)


def board_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.board_metrics(load(spark, sf_dir, "cases"), load(spark, sf_dir, "exceptions"), SINCE)


def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.counts_by(load(spark, sf_dir, "cases"), "channel")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.counts_by(load(spark, sf_dir, "cases"), "severity")


def cases_by_exception_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.cases_by_open_code(load(spark, sf_dir, "exceptions"))


def case_summary_with_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.case_summaries(load(spark, sf_dir, "cases"), load(spark, sf_dir, "exceptions"))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.audit_trail(spark.read.parquet(f"{sf_dir}/events.parquet"), (3, 14, 15))


def policy_number_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = load(spark, sf_dir, "cases").select("case_id", F.col("policy_number").alias("number"))
    return queue.policies_by_number(load(spark, sf_dir, "policies"), cases).select("case_id", "policy_id", "policy_number")


def reference_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.numbered(load(spark, sf_dir, "cases").select("case_id", "received_at"), "FNOL", "received_at", "case_id").select("case_id", "reference")


def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "claims").select("claim_id", queue.money(F.col("reserve_minor"), F.col("currency")).alias("label"))


_TITLE = """concat_ws(' — ', coalesce({loss}, nullif(left(trim(string_split(loss_description, '.')[1]), 60), ''), {line}, 'Notice'),
  nullif(trim(list_extract(string_split(loss_location, ','), -1)), ''))"""


def _title(x: str) -> str:
    return f"list_reduce(['' ] || [upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace({x}, '_', ' '), ' ')], lambda a, b: CASE WHEN a = '' THEN b ELSE a || ' ' || b END)"


def _title_or_null(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN {_title(x)} END)"


ORACLES = {
    "claims_queue_page": oracle_with("claims") + f"""
SELECT claim_id, reference, status, priority, insured_name, {_title_or_null("loss_type")} AS loss_title, reserve_minor, currency,
  CASE WHEN status NOT IN ('approved', 'rejected') THEN greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(reported_at)) / 86400000000.0)::BIGINT) END AS age_days
FROM claims WHERE status IN ('open', 'in_review', 'approved')
  AND (reference ILIKE '%customer%' OR insured_name ILIKE '%customer%' OR policy_number ILIKE '%customer%' OR loss_type ILIKE '%customer%' OR currency ILIKE '%customer%')
ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'standard' THEN 2 WHEN 'routine' THEN 3 ELSE 4 END, reported_at DESC NULLS LAST, claim_id
LIMIT 50 OFFSET 50""",
    "claims_status_facets": oracle_with("cases") + ", f AS (SELECT unnest(['all', " + quoted(queue.FACETS) + """]) AS facet, unnest(range(0, 7))::INT AS position)
SELECT position, facet, (SELECT count(*) FROM cases WHERE facet = 'all' OR status = facet) AS n FROM f""",
    "claims_tiles": oracle_with("claims") + """
SELECT count(*) AS claims, coalesce(sum(reserve_minor) FILTER (WHERE status NOT IN ('approved', 'rejected')), 0)::BIGINT AS open_exposure_minor,
  count(*) FILTER (WHERE fraud_review) AS fraud_review, count(*) FILTER (WHERE over_authority) AS over_authority,
  count(cat_event_id) AS cat_linked FROM claims""",
    "exposure_by_currency": oracle_with("claims") + """
SELECT currency, sum(reserve_minor)::BIGINT AS open_exposure_minor, count(*) AS claims FROM claims WHERE status NOT IN ('approved', 'rejected') GROUP BY currency""",
    "intake_queue_by_severity": oracle_with("cases") + f"""
SELECT case_id, reference, status, channel, severity, received_at, insured_name FROM cases
WHERE channel IN ('email', 'portal') AND status IN ({quoted(REVIEW_STATUSES)}) AND assigned_to IS NULL
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, received_at DESC, case_id LIMIT 100""",
    "intake_search": oracle_with("cases") + """
SELECT case_id, reference, status, channel, severity, received_at, insured_name FROM cases
WHERE concat_ws(chr(1), reference, insured_name, policy_number, loss_location, reporter_organisation, external_reference) ILIKE '%nation_7%'
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, received_at DESC, case_id LIMIT 100""",
    "board_metrics": oracle_with("cases", "exceptions") + f""",
n AS (SELECT count(DISTINCT case_id) FILTER (WHERE status = 'open') AS with_open_exceptions,
  count(DISTINCT case_id) FILTER (WHERE status = 'open' AND code = 'no_policy_match') AS no_policy FROM exceptions),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status IN ({quoted(REVIEW_STATUSES)})) AS needs_review,
  count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_severity, count(*) - count(*) FILTER (WHERE status = 'received') AS processed,
  count(*) FILTER (WHERE status = 'claim_created') AS converted, count(*) FILTER (WHERE received_at >= TIMESTAMP '{SINCE}') AS received_recently FROM cases)
SELECT *, greatest(0, total - no_policy) AS with_policy FROM c, n""",
    "channel_counts": oracle_with("cases") + " SELECT channel, count(*) AS n FROM cases WHERE channel IS NOT NULL GROUP BY channel",
    "severity_counts": oracle_with("cases") + " SELECT severity, count(*) AS n FROM cases WHERE severity IS NOT NULL GROUP BY severity",
    "cases_by_exception_code": oracle_with("exceptions") + " SELECT code, count(DISTINCT case_id) AS cases FROM exceptions WHERE status = 'open' GROUP BY code",
    "case_summary_with_exceptions": oracle_with("cases", "exceptions") + f"""
SELECT case_id, reference, {_TITLE.format(loss=_title_or_null("loss_type"), line=_title_or_null("line_of_business"))} AS title,
  (SELECT count(*) FROM exceptions e WHERE e.case_id = c.case_id AND e.status = 'open') AS open_exceptions,
  (SELECT count(*) FROM exceptions e WHERE e.case_id = c.case_id AND e.status = 'open' AND code IN ({quoted(BLOCKING_CODES)})) AS blocking_exceptions
FROM cases c""",
    "audit_trail": "SELECT event_id, ts, user_id, event_type FROM events WHERE user_id IN (3, 14, 15) ORDER BY ts DESC, event_id DESC LIMIT 200",
    "policy_number_lookup": oracle_with("cases", "policies") + f"""
SELECT c.case_id, p.policy_id, p.policy_number FROM cases c JOIN policies p ON {form("c.policy_number")} = {form("p.policy_number")}""",
    "reference_sequence": oracle_with("cases") + """, numbered AS (
SELECT case_id, year(received_at)::VARCHAR AS y, (row_number() OVER (PARTITION BY year(received_at) ORDER BY received_at, case_id))::VARCHAR AS n FROM cases)
SELECT case_id, 'FNOL-' || y || '-' || lpad(n, greatest(6, length(n))::INT, '0') AS reference FROM numbered""",
    "money_labels": oracle_with("claims") + """
SELECT claim_id, CASE currency WHEN 'GBP' THEN '£' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'SGD' THEN 'S$' ELSE '' END ||
  CASE WHEN abs(reserve_minor) >= 100000000 THEN regexp_replace(regexp_replace(format('{:,.2f}', reserve_minor / 100000000.0::DOUBLE), '0+$', ''), '\\.$', '') || 'm'
    WHEN abs(reserve_minor) >= 100000 THEN regexp_replace(regexp_replace(format('{:,.1f}', reserve_minor / 100000.0::DOUBLE), '0+$', ''), '\\.$', '') || 'k'
    ELSE format('{:,}', round_even(reserve_minor / 100.0::DOUBLE, 0)::BIGINT) END AS label FROM claims""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
