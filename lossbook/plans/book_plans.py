"""Queries of whole-book reads and of the assessment from end to end, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import assessment, book, triage
from lossbook.plans import assess_plans, match_plans
from lossbook.plans import dialect as d
from lossbook.sources.adapters import load, oracle_with
from lossbook.store import saved
from lossbook.vocab import BLOCKING_CODES, STATUS_FOR_CODE

READ_COLUMNS = ["insured_name", "policy_number", "loss_location", "loss_country", "loss_description", "cause_of_loss", "loss_type", "affected_assets", "date_of_loss", "estimated_loss_minor", "injuries", "reporter_name"]


def case_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups as people type them: in small letters with blanks around."""
    cases = load(spark, sf_dir, "cases").select("case_id", "reference", "status")
    wanted = cases.filter("case_id % 10 = 3").select(F.concat(F.lit(" "), F.lower("reference"), F.lit(" ")).alias("reference"))
    return book.by_reference(cases, wanted)


def case_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = book.with_children(*[load(spark, sf_dir, t) for t in ("cases", "fields", "exceptions")])
    return got.select(
        "case_id", "reference", F.array_join(F.transform("fields", lambda x: F.concat(x["field_no"].cast("string"), F.lit("="), x["value"])), ",").alias("fields"),
        F.array_join(F.transform("exceptions", lambda x: F.concat(x["code"], F.lit(":"), x["status"])), ",").alias("exceptions"),
    )


def policies_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.listed(load(spark, sf_dir, "policies"), [F.col("policy_number"), F.col("policy_id")], 500).select("policy_id", "policy_number", "insured_name")


def events_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.listed(load(spark, sf_dir, "cat_events"), [F.col("start_date").desc(), F.col("event_id")], 200).select("event_id", "reference", "event_type")


def claims_same_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.same_policy(load(spark, sf_dir, "claims"))


def claims_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.scoped(load(spark, sf_dir, "claims"), handler=14, fraud_only=True).select("claim_id", "handler_id", "status")


def queue_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total beside a page: a count over the page's own filter."""
    return book.scoped(load(spark, sf_dir, "claims").filter("status IN ('open', 'in_review')"), cat_only=True).agg(F.count(F.lit(1)).alias("total"))


def handler_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.workload(load(spark, sf_dir, "handlers"), load(spark, sf_dir, "claims"))


def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = load(spark, sf_dir, "cases")
    return cases.select("case_id", book.coverage(cases, READ_COLUMNS).alias("coverage"))


def _upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases beside what matching found for them: policy, duplicates and catastrophe. An exact match is bound unless a person confirmed a policy, which stays; others stay for a person."""
    cases = load(spark, sf_dir, "cases")
    ranked = match_plans.policy_match_ranked(spark, sf_dir)
    matches = ranked.groupBy("case_id").agg(F.max("overall").alias("overall"), F.count(F.lit(1)).alias("candidates"), F.min_by("policy_id", "rank").alias("best_policy"))
    twins = match_plans.duplicate_tallies(spark, sf_dir)
    events = match_plans.cat_attribution(spark, sf_dir).select("case_id", F.col("event_id").alias("cat_event_id"))
    matches, twins, events = (saved(x, f"book-{name}") for x, name in ((matches, "matches"), (twins, "twins"), (events, "events")))  # later rules read these, not their plans
    rows = cases.join(matches, "case_id", "left").join(twins, "case_id", "left").join(events, "case_id", "left")
    stored = F.when(F.col("case_id") % 7 != 0, F.col("custkey"))
    bound = F.when(F.col("policy_confirmed"), stored).when(F.col("overall") == "exact", F.col("best_policy"))
    policies = load(spark, sf_dir, "policies").select(
        "policy_id", F.col("policy_number").alias("matched_number"), "effective_date", "expiry_date", "limit_minor", "perils", "exclusions", "primary_location", "region",
        F.col("country").alias("policy_country"), F.col("status").alias("policy_status"),
    )
    rows = rows.withColumn("bound", bound).join(policies, F.col("bound") == F.col("policy_id"), "left")
    return rows.withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "duplicates": F.coalesce("duplicates", F.lit(0)), "duplicate_score": F.coalesce("duplicate_score", F.lit(0.0))})


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading left behind: mean confidence and values that people changed."""
    rows = load(spark, sf_dir, "fields")
    return rows.groupBy("case_id").agg(F.round(F.avg("confidence"), 6).alias("extraction_confidence"), F.count_if("human_modified").alias("corrections"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on a case already: documents that couldn't be read, and whether a person settled the catastrophe match."""
    settled = (F.col("code") == "cat_match") & (F.col("status") == "resolved")
    return load(spark, sf_dir, "exceptions").groupBy("case_id").agg(F.count_if(F.col("code") == "document_unreadable").alias("unreadable"), F.max(settled).alias("cat_confirmed"))


def assessed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice from candidates to triage, each rule on what the ones before it found."""
    rows = _upstream(spark, sf_dir).join(assessment.completeness(load(spark, sf_dir, "cases")), "case_id").join(_readings(spark, sf_dir), "case_id", "left")
    rows = rows.join(_decisions(spark, sf_dir), "case_id", "left")
    cat = F.col("cat_event_id").isNotNull()
    rows = rows.withColumns({
        "extraction_failed": F.col("status") == "ai_processing_failed", "cat_confirmed": F.coalesce("cat_confirmed", F.lit(False)), "unreadable": F.coalesce("unreadable", F.lit(0)), "corrections": F.coalesce("corrections", F.lit(0)),
        "s": assessment.severity(F.col("limit_minor"), cat), "v": assessment.coverage(),
    })
    rows = rows.withColumn("f", assessment.fraud(F.col("duplicates"), F.col("corrections"), F.col("unreadable")))
    rows = rows.withColumns({"severity_found": F.col("s.severity"), "fraud_level": F.col("f.level"), "coverage_indicator": F.col("v.indicator")})
    rows = rows.withColumn("codes", F.transform(assessment.raised_exceptions(), lambda x: x["code"]))
    rows = rows.withColumns({
        "new_status": assessment.derived_status(F.col("status"), F.col("codes"), F.col("extraction_failed")), "blockers": F.array_join(assessment.claim_blockers(F.col("codes")), ","),
    })
    rows = triage.triaged(rows, F.col("severity_found"), F.col("fraud_level"), cat)
    return rows.select(
        "case_id", "overall", "candidates", "policy_id", "duplicates", "duplicate_score", "cat_event_id", F.col("score").alias("completeness"), "severity_found", "fraud_level", "coverage_indicator",
        F.array_join("codes", ",").alias("codes"), "new_status", "blockers", "t.route", "t.priority",
    )


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "cat_events").select("event_id", F.concat("reference", F.lit(" ("), "event_type", F.lit(")")).alias("event_name"))
    rows = assess_plans._with_policy(spark, sf_dir).join(load(spark, sf_dir, "policies").select("policy_id", F.col("policy_number").alias("matched_number")), "policy_id", "left")
    rows = rows.join(assessment.completeness(load(spark, sf_dir, "cases")), "case_id").join(match_plans.cat_attribution(spark, sf_dir).select("case_id", "event_id"), "case_id", "left")
    return rows.join(events, "event_id", "left").select("case_id", book.summary_text().alias("summary"))


_NESTED = ", ".join(f"{short} AS ({sql})" for short, sql in (("mr", match_plans.ORACLES["policy_match_ranked"]), ("ds", match_plans.ALL_DUPLICATES), ("ce", match_plans.ORACLES["cat_attribution"])))
_COMPLETE = f""", cf AS (SELECT case_id, list(path ORDER BY n) FILTER (WHERE NOT present) AS missing, list(path ORDER BY n) FILTER (WHERE NOT present AND critical) AS gone,
  round(sum(CASE WHEN present THEN (CASE WHEN critical THEN 3.0 ELSE 1.0 END) ELSE 0 END)::DOUBLE / sum(CASE WHEN critical THEN 3.0 ELSE 1.0 END)::DOUBLE, 4) AS complete FROM ({assess_plans._FIELDS}) GROUP BY case_id)"""
_BOOK = oracle_with("cases", "policies", "claims", "cat_events", "fields", "exceptions") + ", " + _NESTED + _COMPLETE + """,
m1 AS (SELECT case_id, max(overall) AS overall, count(*) AS candidates, arg_min(policy_id, rank) AS best_policy FROM mr GROUP BY case_id),
d1 AS (SELECT case_id, count(*) AS duplicates, max(score) AS duplicate_score FROM ds GROUP BY case_id),
f1 AS (SELECT case_id, round(avg(confidence), 6) AS sure, count(*) FILTER (WHERE human_modified) AS corrections FROM fields GROUP BY case_id),
x1 AS (SELECT case_id, count(*) FILTER (WHERE code = 'document_unreadable') AS unreadable, bool_or(code = 'cat_match' AND status = 'resolved') AS cat_confirmed FROM exceptions GROUP BY case_id),
b1 AS (SELECT c.*, m1.overall, coalesce(m1.candidates, 0) AS candidates, coalesce(d1.duplicates, 0) AS duplicates, coalesce(d1.duplicate_score, 0)::DOUBLE AS duplicate_score,
    ce.event_id AS cat_event_id, f1.sure, coalesce(f1.corrections, 0) AS corrections, cf.gone, cf.complete,
    coalesce(x1.unreadable, 0) AS unreadable, coalesce(x1.cat_confirmed, false) AS cat_confirmed,
    CASE WHEN c.policy_confirmed THEN CASE WHEN c.case_id % 7 <> 0 THEN c.custkey END WHEN m1.overall = 'exact' THEN m1.best_policy END AS bound
  FROM cases c LEFT JOIN m1 USING (case_id) LEFT JOIN d1 USING (case_id) LEFT JOIN ce USING (case_id) LEFT JOIN f1 USING (case_id) LEFT JOIN x1 USING (case_id) JOIN cf USING (case_id)),
wp AS (SELECT b1.*, p.policy_id, p.effective_date, p.expiry_date, p.limit_minor, p.perils, p.exclusions, p.primary_location, p.region, p.country AS policy_country, p.status AS policy_status
  FROM b1 LEFT JOIN policies p ON b1.bound = p.policy_id)""" + assess_plans._severity("cat_event_id IS NOT NULL") + assess_plans._fraud_sql("sw").replace(
    "case_id % 5 = 0", "duplicates > 0").replace("case_id % 8 >= 5", "corrections >= 5").replace("case_id % 9 = 0", "unreadable > 0") + assess_plans._coverage_sql("fl") + f""",
ax AS (SELECT *, status = 'ai_processing_failed' AS failed, (['low', 'medium', 'high', 'critical'])[top + 1] AS severity_found FROM cv),
ay AS (SELECT *, [x FOR x IN [
  CASE WHEN failed THEN 'ai_processing_failed' END,
  CASE WHEN NOT policy_confirmed THEN CASE WHEN coalesce(overall, 'none') = 'none' THEN 'no_policy_match' WHEN overall = 'possible' AND candidates > 1 THEN 'multiple_policy_matches'
    WHEN overall IN ('high', 'possible') THEN 'unconfirmed_policy_match' END END,
  CASE WHEN date_of_loss > received_at THEN 'future_loss_date' END, CASE WHEN len({assess_plans._CONFLICTS}) > 0 THEN 'conflicting_dates' END,
  CASE WHEN policy_id IS NOT NULL AND date_of_loss::DATE NOT BETWEEN effective_date AND expiry_date THEN 'outside_policy_period' END,
  CASE WHEN limit_minor <> 0 AND estimated_loss_minor > limit_minor THEN 'exceeds_policy_limit' END, CASE WHEN len(gone) > 0 THEN 'missing_critical_information' END,
  CASE WHEN duplicates > 0 THEN 'possible_duplicate' END, CASE WHEN top >= 2 THEN 'high_severity' END, CASE WHEN level <> 'low' THEN 'fraud_indicator' END,
  CASE WHEN indicator IN ('review_required', 'possible_exclusion') THEN 'coverage_issue' END, CASE WHEN cat_event_id IS NOT NULL AND NOT cat_confirmed THEN 'cat_match' END,
  CASE WHEN sure < 0.6 AND NOT failed THEN 'low_extraction_confidence' END, CASE WHEN unreadable > 0 THEN 'document_unreadable' END] IF x IS NOT NULL] AS codes FROM ax)""" + assess_plans._TRIAGE.replace(
    "case_id % 43 = 0 AS cat FROM fl", "cat_event_id IS NOT NULL AS cat FROM ay").replace("severity = 'critical'", "severity_found = 'critical'").replace("severity = 'high'", "severity_found = 'high'").replace("severity = 'medium'", "severity_found = 'medium'")

ORACLES = {
    "case_by_reference": oracle_with("cases") + " SELECT case_id, reference, status FROM cases WHERE reference IN (SELECT upper(trim(' ' || lower(reference) || ' ')) FROM cases WHERE case_id % 10 = 3)",
    "case_children": oracle_with("cases", "fields", "exceptions") + """,
f AS (SELECT case_id, string_agg(field_no::VARCHAR || '=' || value, ',' ORDER BY field_no) AS fields FROM fields GROUP BY case_id),
e AS (SELECT case_id, string_agg(code || ':' || status, ',' ORDER BY created_at, code, status) AS exceptions FROM exceptions GROUP BY case_id)
SELECT case_id, reference, coalesce(fields, '') AS fields, coalesce(exceptions, '') AS exceptions FROM cases LEFT JOIN f USING (case_id) LEFT JOIN e USING (case_id)""",
    "policies_listed": oracle_with("policies") + " SELECT policy_id, policy_number, insured_name FROM policies ORDER BY policy_number, policy_id LIMIT 500",
    "events_listed": oracle_with("cat_events") + " SELECT event_id, reference, event_type FROM cat_events ORDER BY start_date DESC, event_id LIMIT 200",
    "claims_same_policy": oracle_with("claims") + f""",
k AS (SELECT claim_id, {d.ref("policy_number")} AS key, row_number() OVER (PARTITION BY {d.ref("policy_number")} ORDER BY reported_at DESC NULLS LAST, claim_id DESC)::INT AS nth FROM claims)
SELECT a.claim_id, b.claim_id AS other_id, b.nth FROM k a JOIN k b USING (key) WHERE b.nth <= 6 AND a.claim_id <> b.claim_id""",
    "claims_in_scope": oracle_with("claims") + " SELECT claim_id, handler_id, status FROM claims WHERE handler_id = 14 AND fraud_review",
    "queue_page_total": oracle_with("claims") + " SELECT count(*) AS total FROM claims WHERE status IN ('open', 'in_review') AND cat_event_id IS NOT NULL",
    "handler_workload": oracle_with("claims", "handlers") + """, w AS (SELECT handler_id, count(*) AS held FROM claims WHERE status NOT IN ('approved', 'rejected') GROUP BY handler_id)
SELECT handler_id, full_name, coalesce(held, 0) AS open_now, capacity, greatest(0, capacity - coalesce(held, 0))::BIGINT AS headroom FROM handlers LEFT JOIN w USING (handler_id)""",
    "extraction_coverage": oracle_with("cases") + f""" SELECT case_id, round(({" + ".join(f"coalesce(trim({c}::VARCHAR) <> '', false)::INT" for c in READ_COLUMNS)}) / {len(READ_COLUMNS)}.0::DOUBLE, 2) AS coverage FROM cases""",
    "assessed_book": _BOOK + f""" SELECT case_id, overall, candidates, policy_id, duplicates, duplicate_score, cat_event_id, complete AS completeness, severity_found, level AS fraud_level, indicator AS coverage_indicator,
  array_to_string(codes, ',') AS codes, CASE WHEN status IN ('claim_created', 'rejected', 'cancelled', 'referred') THEN status WHEN failed THEN 'ai_processing_failed'
  {" ".join(f"WHEN list_contains(codes, '{c}') THEN '{s}'" for c, s in STATUS_FOR_CODE)} ELSE 'ready_for_claim' END AS new_status,
  array_to_string([c FOR c IN [{d.quoted(BLOCKING_CODES)}] IF list_contains(codes, c)] || [x FOR x IN [CASE WHEN policy_id IS NULL THEN 'policy' END,
    CASE WHEN coalesce(trim(insured_name), '') = '' THEN 'insured_name' END, CASE WHEN date_of_loss IS NULL THEN 'date_of_loss' END,
    CASE WHEN coalesce(trim(loss_description), '') = '' THEN 'loss_description' END] IF x IS NOT NULL], ',') AS blockers, route, priority FROM te""",
    "summary_text": oracle_with("cases", "policies", "cat_events") + f", ce AS ({match_plans.ORACLES['cat_attribution']})" + assess_plans._P + _COMPLETE + """,
x AS (SELECT wp.*, p.policy_number AS matched, e.reference || ' (' || e.event_type || ')' AS event_name, complete, coalesce(missing, []) AS missing,
    nullif(left(trim(loss_description), 400), '') AS told, nullif(trim(concat_ws(' ', nullif(reporter_name, ''), '(' || nullif(reporter_organisation, '') || ')')), '') AS reporter,
    coalesce(nullif(wp.insured_name, ''), nullif(wp.insured_organisation, '')) AS insured
  FROM wp JOIN cf USING (case_id) LEFT JOIN policies p ON p.policy_id = wp.policy_id LEFT JOIN ce USING (case_id) LEFT JOIN cat_events e USING (event_id)),
y AS (SELECT *, concat_ws(' and ', CASE WHEN fatalities > 0 THEN fatalities::VARCHAR || CASE WHEN fatalities = 1 THEN ' fatality' ELSE ' fatalities' END END,
    CASE WHEN injuries > 0 THEN injuries::VARCHAR || CASE WHEN injuries = 1 THEN ' person injured' ELSE ' people injured' END END) AS toll FROM x)
SELECT case_id, concat_ws(' ', CASE WHEN told LIKE '%.' THEN told ELSE told || '.' END,
  CASE WHEN told IS NOT NULL THEN 'Reported' ELSE 'A loss was reported' END || coalesce(' by ' || reporter, '') || coalesce(' for ' || insured, '')
    || coalesce(' against policy ' || nullif(policy_number, ''), ', with no policy identified') || coalesce(' at ' || nullif(loss_location, ''), '')
    || coalesce(', loss dated ' || strftime(date_of_loss, '%d %B %Y'), '') || '.',
  CASE WHEN estimated_loss_minor <> 0 THEN 'Initial estimated loss is GBP ' || format('{:,}', round_even(estimated_loss_minor / 100.0::DOUBLE, 0)::BIGINT) || '.' END,
  CASE WHEN matched IS NULL THEN 'No policy has been matched to the notification.' ELSE 'The matched policy ' || matched || ' ran ' || strftime(effective_date, '%d %b %Y') || ' to ' || strftime(expiry_date, '%d %b %Y') || '.' END,
  'The loss may be attributable to ' || event_name || '.',
  CASE WHEN toll <> '' THEN toll || '.' WHEN injuries = 0 AND fatalities = 0 THEN 'No injuries or fatalities were reported.' ELSE 'No injuries reported.' END,
  'Documentation is ' || round_even(complete * 100, 0)::BIGINT::VARCHAR || '% complete' || CASE WHEN len(missing) = 0 THEN '.' ELSE '; still missing ' || array_to_string(missing[1:4], ', ') || '.' END) AS summary FROM y""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
