"""Queries of assessments, classification, triage, status and assignment, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.operators import assessment, merge, triage
from lossbook.plans import dialect as d
from lossbook.sources.adapters import load, oracle_with
from lossbook.store import saved
from lossbook.vocab import (
    ASSIGNMENT_WEIGHTS, BASE_REQUIRED, BLOCKING_CODES, INJURY_SIGNALS, LINE_KEYWORDS, LINE_REQUIRED, LITIGATION_SIGNALS, ROUTES, SPECIALIST_LINES,
    STATUS_FOR_CODE, TRANSITIONS,
)


def _with_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases beside the policy of their customer (every seventh has none)."""
    cases, policies = load(spark, sf_dir, "cases"), load(spark, sf_dir, "policies")
    own = policies.select(
        "policy_id", "effective_date", "expiry_date", "limit_minor", "perils", "exclusions", "primary_location", "region",
        F.col("country").alias("policy_country"), F.col("status").alias("policy_status"),
    )
    return cases.join(own, (F.col("custkey") == F.col("policy_id")) & (F.col("case_id") % 7 != 0), "left")


def _confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading confidence of the description and the location, from the extracted fields."""
    paths = F.create_map(F.lit(1), F.lit("loss.loss_description"), F.lit(2), F.lit("loss.loss_location"), F.lit(3), F.lit("policy.insured_name"))
    rows = load(spark, sf_dir, "fields").filter("field_no <= 3").withColumn("path", paths[F.col("field_no")])
    return rows.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "confidence"))).alias("confidences"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assessment.completeness(load(spark, sf_dir, "cases"), _confidences(spark, sf_dir))
    return got.select("case_id", "score", *[F.array_join(c, ",").alias(c) for c in ("missing", "missing_critical", "uncertain")])


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cases").select("case_id", F.explode(assessment.conflicts()).alias("path"))


def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_policy(spark, sf_dir).select("case_id", assessment.severity(F.col("limit_minor"), F.col("case_id") % 43 == 0).alias("s"))
    return rows.select("case_id", "s.severity", "s.confidence", F.array_join("s.factors", ",").alias("factors"))


def _fraud(rows: DataFrame) -> DataFrame:
    return rows.withColumn("f", assessment.fraud((F.col("case_id") % 5 == 0).cast("int"), F.col("case_id") % 8, (F.col("case_id") % 9 == 0).cast("int")))


def fraud_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fraud(_with_policy(spark, sf_dir)).select("case_id", "f.level", "f.score", F.array_join("f.indicators", ",").alias("indicators"))


def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_policy(spark, sf_dir).select("case_id", assessment.coverage().alias("v"))
    return rows.select("case_id", "v.indicator", "v.confidence", "v.in_force", "v.peril", "v.limit", "v.location", "v.status")


def classify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "loss_description", "affected_assets")
    rows = load(spark, sf_dir, "cases").select("case_id", triage.classify_line(text, F.when(F.col("case_id") % 2 == 0, F.col("line_of_business"))).alias("c"))
    return rows.select("case_id", "c.line", "c.confidence", "c.score")


def classify_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = triage.classify_line(F.col("loss_description"))
    told = F.when(F.col("case_id") % 5 == 0, "underwater basket weaving").otherwise(F.col("line_of_business"))
    rows = load(spark, sf_dir, "cases").select("case_id", base.alias("b"), told.alias("told"), (0.4 + F.col("case_id") % 6 * 0.1).alias("sure"))
    return rows.select("case_id", triage.reconcile(F.col("told"), F.col("sure"), F.col("b.line"), F.col("b.confidence")).alias("r")).select("case_id", "r.line", F.round("r.confidence", 4).alias("confidence"))


def triage_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triage.triaged(_fraud(_with_policy(spark, sf_dir)), F.col("severity"), F.col("f.level"), F.col("case_id") % 43 == 0)
    return rows.select("case_id", F.array_join("t.categories", ",").alias("categories"), "t.route", "t.team", "t.required_skill", "t.priority", "t.confidence")


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with everything the exception rules read."""
    rows = _with_policy(spark, sf_dir).join(assessment.completeness(load(spark, sf_dir, "cases")), "case_id")
    rows = _fraud(rows).withColumn("s", assessment.severity(F.col("limit_minor"), F.lit(False))).withColumn("v", assessment.coverage())
    k = F.col("case_id")
    return rows.select(
        "*", F.col("s.severity").alias("severity_found"), F.col("f.level").alias("fraud_level"), F.col("v.indicator").alias("coverage_indicator"),
        F.when(k % 7 == 0, "none").when(k % 3 == 0, "possible").when(k % 3 == 1, "high").otherwise("exact").alias("overall"), (k % 3).alias("candidates"),
        (k % 5 == 0).cast("int").alias("duplicates"), (0.6 + k % 4 * 0.1).alias("duplicate_score"), F.when(k % 43 == 0, k).alias("cat_event_id"),
        (k % 86 == 0).alias("cat_confirmed"), (k % 10 / 10).alias("extraction_confidence"), (k % 101 == 0).alias("extraction_failed"), (k % 9 == 0).cast("int").alias("unreadable"),
    )


def exceptions_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("case_id", F.inline(assessment.raised_exceptions()))


def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir).withColumn("codes", F.transform(assessment.raised_exceptions(), lambda x: x["code"]))
    return rows.select("case_id", "status", assessment.derived_status(F.col("status"), F.col("codes"), F.col("extraction_failed")).alias("new_status"))


def claim_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir).withColumn("codes", F.transform(assessment.raised_exceptions(), lambda x: x["code"]))
    return rows.select("case_id", F.array_join(assessment.claim_blockers(F.col("codes")), ",").alias("blockers"))


def claims_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for ready notices that have none yet, numbered by year."""
    known = load(spark, sf_dir, "claims").select(F.col("claim_id").alias("case_id"))
    ready = load(spark, sf_dir, "cases").filter("status = 'ready_for_claim' and policy_confirmed").join(known, "case_id", "left_anti")
    rows = merge.numbered(ready, "CLM", "received_at", "case_id")
    return rows.select(F.col("case_id"), F.col("reference").alias("claim_reference"), "insured_name", F.coalesce("estimated_loss_minor", F.lit(0)).alias("reserve_minor"), "severity")


def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status against every other, from the statuses that occur."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    seen = load(spark, sf_dir, "cases").select("status").distinct()
    a, b = seen.select(F.col("status").alias("current")), F.broadcast(seen.select(F.col("status").alias("target")))
    allowed = F.coalesce(F.array_contains(F.element_at(table, F.col("current")), F.col("target")), F.lit(False))
    return a.join(b, F.lit(True)).select("current", "target", ((F.col("current") == F.col("target")) | allowed).alias("allowed"))


def _demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triage.triaged(_fraud(_with_policy(spark, sf_dir)), F.col("severity"), F.col("f.level"), F.col("case_id") % 43 == 0)
    return rows.select(
        F.col("case_id").alias("claim_id"), "t.team", "t.required_skill", "severity", "line_of_business", F.col("loss_country").alias("country"), "t.priority", F.col("received_at").alias("moment")
    )


def handler_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.handler_scores(_demands(spark, sf_dir), load(spark, sf_dir, "handlers")).drop("full_name")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = saved(_demands(spark, sf_dir), "assignment-claims")
    return triage.assignments(claims, triage.leading_scores(claims, load(spark, sf_dir, "handlers")))


def assignment_with_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.assigned_with_load(saved(_demands(spark, sf_dir), "assignment-claims"), load(spark, sf_dir, "handlers"))


def handler_load_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.load_after(load(spark, sf_dir, "handlers"), assignment_with_load(spark, sf_dir))


def over_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, handlers = load(spark, sf_dir, "claims"), load(spark, sf_dir, "handlers").select("handler_id", "authority_minor")
    over = F.col("reserve_minor") > F.col("authority_minor")
    return claims.join(handlers, "handler_id", "left").filter(over).select("claim_id", "handler_id", (F.col("reserve_minor") - F.col("authority_minor")).alias("excess_minor"))


_P = """, wp AS (SELECT c.*, p.policy_id, p.effective_date, p.expiry_date, p.limit_minor, p.perils, p.exclusions, p.primary_location, p.region,
  p.country AS policy_country, p.status AS policy_status FROM cases c LEFT JOIN policies p ON c.custkey = p.policy_id AND c.case_id % 7 <> 0)"""
_WP = oracle_with("cases", "policies") + _P


def _has(column: str) -> str:
    if column == "documents":
        return "documents > 0"
    if column in ("third_parties", "witnesses"):
        return f"coalesce({column}, false)"
    if column in ("date_of_loss", "estimated_loss_minor", "repair_estimate_minor", "injuries"):
        return f"{column} IS NOT NULL"
    return f"coalesce(trim({column}) <> '', false)"


_FIELDS = " UNION ALL ".join(
    f"SELECT case_id, {n} AS n, '{path}' AS path, {str(critical).lower()} AS critical, {_has(column)} AS present FROM cases" + (f" WHERE line_of_business = '{line}'" if line else "")
    for n, (line, (path, column, critical)) in enumerate([(None, f) for f in BASE_REQUIRED] + [(k, f) for k, v in LINE_REQUIRED.items() for f in v])
)
_SURE = """, sure AS (SELECT case_id, CASE field_no WHEN 1 THEN 'loss.loss_description' WHEN 2 THEN 'loss.loss_location' ELSE 'policy.insured_name' END AS path, confidence
  FROM fields WHERE field_no <= 3)"""
_CONFLICTS = """[x FOR x IN [CASE WHEN date_of_loss > received_at THEN 'loss.date_of_loss' END,
  CASE WHEN estimated_loss_minor <> 0 AND repair_estimate_minor <> 0 AND repair_estimate_minor > estimated_loss_minor * 3 THEN 'financial.repair_estimate' END,
  CASE WHEN coalesce(fatalities, 0) > 0 AND injuries = 0 THEN 'loss.injuries' END] IF x IS NOT NULL]"""
_BAND = "CASE WHEN estimated_loss_minor IS NULL THEN 1 WHEN estimated_loss_minor >= 100000000 THEN 3 WHEN estimated_loss_minor >= 25000000 THEN 2 WHEN estimated_loss_minor >= 2500000 THEN 1 ELSE 0 END"


def _severity(cat: str, source: str = "wp") -> str:
    return f""", sv AS (SELECT *, {_BAND} AS band, coalesce(fatalities, 0) > 0 AS e1, coalesce(injuries, 0) >= 3 AS e2, coalesce(injuries, 0) > 0 AS e3, {cat} AS e8,
  coalesce(limit_minor <> 0 AND estimated_loss_minor <> 0 AND estimated_loss_minor >= limit_minor * 0.75, false) AS near FROM {source}),
sw AS (SELECT *, greatest(band, CASE WHEN e1 THEN 3 ELSE 0 END, CASE WHEN e3 THEN 1 ELSE 0 END,
    CASE WHEN e2 OR business_interruption OR structural_damage OR environmental_exposure OR potential_litigation OR e8 OR near THEN 2 ELSE 0 END) AS top,
  e1::INT + e2::INT + e3::INT + business_interruption::INT + structural_damage::INT + environmental_exposure::INT + potential_litigation::INT + e8::INT AS hits FROM sv)"""


def _fraud_sql(source: str) -> str:
    return f""", fr AS (SELECT *, [x FOR x IN [
  CASE WHEN date_of_loss::DATE - effective_date::DATE BETWEEN 0 AND 30 THEN {{'code': 'loss_near_inception', 'weight': 0.3::DOUBLE}} END,
  CASE WHEN expiry_date::DATE - date_of_loss::DATE BETWEEN 0 AND 30 THEN {{'code': 'loss_near_expiry', 'weight': 0.2::DOUBLE}} END,
  CASE WHEN floor((epoch_us(received_at) - epoch_us(date_of_loss)) / 86400000000.0) >= 30 THEN {{'code': 'late_notification', 'weight': 0.25::DOUBLE}} END,
  CASE WHEN case_id % 5 = 0 THEN {{'code': 'duplicate_submission', 'weight': 0.3::DOUBLE}} END,
  CASE WHEN len({_CONFLICTS}) > 0 THEN {{'code': 'inconsistent_information', 'weight': 0.25::DOUBLE}} END,
  CASE WHEN case_id % 8 >= 5 THEN {{'code': 'supplied_information_changed', 'weight': 0.15::DOUBLE}} END,
  CASE WHEN case_id % 9 = 0 THEN {{'code': 'document_inconsistency', 'weight': 0.1::DOUBLE}} END,
  CASE WHEN coalesce(loss_description, '') <> '' AND len({d.tokens("loss_description")}) < 4 THEN {{'code': 'sparse_description', 'weight': 0.1::DOUBLE}} END
  ] IF x IS NOT NULL] AS found FROM {source}),
fs AS (SELECT *, list_reduce(list_reverse_sort([i.weight FOR i IN found]), lambda s, w: s + w * (1 - s), 0::DOUBLE) AS risk FROM fr),
fl AS (SELECT *, CASE WHEN risk >= 0.65 THEN 'high' WHEN risk >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM fs)"""


def _mention(phrases: str) -> str:
    return f"coalesce(len([p FOR p IN string_split({phrases}, ',') IF len({d.all_tokens('p')}) > 0 AND list_has_all(said, {d.all_tokens('p')})]) > 0, false)"


def _coverage_sql(source: str) -> str:
    return f""", ca AS (SELECT *, {d.norm("concat_ws(' ', cause_of_loss, loss_type, loss_description)")} AS txt FROM {source}),
cb AS (SELECT *, {d.all_tokens("txt")} AS said, {d.tokens("loss_location")} AS there FROM ca),
cc AS (SELECT *, CASE WHEN date_of_loss IS NULL THEN 'unknown' WHEN date_of_loss::DATE BETWEEN effective_date AND expiry_date THEN 'pass' ELSE 'fail' END AS c_force,
  CASE WHEN txt = '' THEN 'unknown' WHEN {_mention("exclusions")} THEN 'fail' WHEN {_mention("perils")} THEN 'pass' WHEN perils IS NULL THEN 'unknown' ELSE 'attention' END AS c_peril,
  CASE WHEN estimated_loss_minor IS NULL OR limit_minor IS NULL OR limit_minor = 0 THEN 'unknown' WHEN estimated_loss_minor > limit_minor THEN 'fail'
    WHEN estimated_loss_minor > limit_minor * 0.75 THEN 'attention' ELSE 'pass' END AS c_limit,
  CASE WHEN coalesce(loss_location, '') = '' THEN 'unknown' WHEN list_has_any({d.tokens("primary_location")}, there) OR list_has_any({d.tokens("region")}, there)
    OR list_has_any({d.tokens("policy_country")}, there) THEN 'pass' ELSE 'attention' END AS c_place,
  CASE WHEN coalesce(policy_status, 'active') = 'active' THEN 'pass' ELSE 'attention' END AS c_status FROM cb),
cd AS (SELECT *, 'attention' IN (c_peril, c_limit, c_place, c_status) OR NOT policy_confirmed AS doubt FROM cc),
cv AS (SELECT *, CASE WHEN policy_id IS NULL THEN 'policy_not_located' WHEN c_force = 'fail' OR c_peril = 'fail' THEN 'possible_exclusion'
    WHEN c_force = 'unknown' OR c_peril = 'unknown' THEN 'insufficient_information' WHEN doubt THEN 'review_required' ELSE 'likely_covered' END AS indicator,
  CASE WHEN policy_id IS NULL THEN 0.9::DOUBLE WHEN c_force = 'fail' THEN 0.85::DOUBLE WHEN c_peril = 'fail' THEN 0.7::DOUBLE
    WHEN c_force = 'unknown' OR c_peril = 'unknown' OR doubt THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END AS cover_confidence FROM cd)"""


def _hits(text: str, keywords: str) -> str:
    return " + ".join(f"(CASE WHEN contains({text}, '{k}') THEN {1 + 0.5 * k.count(' ')} ELSE 0 END)" for k in keywords)


def _classify(text: str, policy_line: str | None) -> str:
    rows = ", ".join(
        f"{{'s': -(({_hits('low', v)}) + {f'(CASE WHEN {policy_line} = {chr(39)}{k}{chr(39)} THEN 3 ELSE 0 END)' if policy_line else '0'})::DOUBLE, 'n': {n}, 'line': '{k}'}}"
        for n, (k, v) in enumerate(LINE_KEYWORDS.items())
    )
    return f""", ka AS (SELECT *, lower(coalesce({text}, '')) AS low FROM cases), kb AS (SELECT *, list_sort([{rows}]) AS ranked FROM ka),
kc AS (SELECT *, CASE WHEN ranked[1].s < 0 THEN ranked[1].line ELSE 'unknown' END AS line,
  CASE WHEN ranked[1].s < 0 THEN round(least(0.85::DOUBLE, 0.35::DOUBLE + 0.1::DOUBLE * (ranked[2].s - ranked[1].s)), 2) ELSE 0::DOUBLE END AS sure, -ranked[1].s AS best FROM kb)"""


def _any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_TRIAGE = f""", ta AS (SELECT *, {d.norm("concat_ws(' ', loss_description, cause_of_loss, affected_assets, authorities_involved, source_body)")} AS ttxt, case_id % 43 = 0 AS cat FROM fl),
tb AS (SELECT *, level IN ('medium', 'high') AS t1, potential_litigation OR {_any("ttxt", LITIGATION_SIGNALS)} AS t2, coalesce(estimated_loss_minor, 0) >= 50000000 AS large,
  coalesce(estimated_loss_minor, 0) < 50000000 AND coalesce(severity = 'critical', false) AS crit, coalesce(fatalities, 0) > 0 OR {_any("ttxt", INJURY_SIGNALS)} AS hurt,
  coalesce(line_of_business IN ({d.quoted(SPECIALIST_LINES)}), false) AS t5,
  business_interruption OR coalesce(injuries, 0) > 0 OR coalesce(severity = 'high', false) AS busy FROM ta),
tc AS (SELECT *, large OR crit OR hurt AS t3, NOT (t1 OR t2 OR large OR crit OR hurt OR cat OR t5) AS plain FROM tb),
td AS (SELECT *, [x FOR x IN [CASE WHEN t1 THEN 'fraud_review' END, CASE WHEN t2 THEN 'litigation_risk' END, CASE WHEN t3 THEN 'major_loss' END, CASE WHEN cat THEN 'cat_claim' END,
  CASE WHEN t5 THEN 'specialist_required' END, CASE WHEN plain AND busy THEN 'complex' END, CASE WHEN plain AND NOT busy THEN 'simple' END] IF x IS NOT NULL] AS categories,
  greatest(CASE WHEN level = 'high' THEN 0.9 WHEN t1 THEN 0.6 ELSE 0 END, CASE WHEN t2 THEN 0.8 ELSE 0 END, CASE WHEN large THEN 0.9 WHEN crit THEN 0.8 ELSE 0 END,
    CASE WHEN hurt THEN 1.0 ELSE 0 END, CASE WHEN cat THEN 0.7 ELSE 0 END, CASE WHEN t5 THEN 0.6 ELSE 0 END, CASE WHEN plain THEN 0.5 ELSE 0 END)::DOUBLE AS heavy,
  CASE WHEN severity = 'critical' OR t3 THEN 'urgent' WHEN severity = 'high' OR t1 OR t2 OR cat THEN 'high' WHEN severity = 'medium' OR (plain AND busy) THEN 'standard' ELSE 'routine' END AS priority FROM tc),
te AS (SELECT *, CASE categories[1] {" ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in ROUTES)} END AS route,
  CASE categories[1] {" ".join(f"WHEN '{r[0]}' THEN '{r[2]}'" for r in ROUTES)} END AS team,
  CASE categories[1] {" ".join(f"WHEN '{r[0]}' THEN '{r[3]}'" for r in ROUTES if r[3])} END AS required_skill FROM td)"""

_ASSESSED = _WP + """, cf AS (SELECT case_id, list(path ORDER BY n) FILTER (WHERE NOT present AND critical) AS gone FROM (""" + _FIELDS + """) GROUP BY case_id)
, wq AS (SELECT wp.*, gone FROM wp JOIN cf USING (case_id))""" + _severity("false", "wq") + _fraud_sql("sw") + _coverage_sql("fl") + f""",
ax AS (SELECT *, CASE WHEN case_id % 7 = 0 THEN 'none' WHEN case_id % 3 = 0 THEN 'possible' WHEN case_id % 3 = 1 THEN 'high' ELSE 'exact' END AS overall, case_id % 3 AS candidates,
  case_id % 101 = 0 AS failed FROM cv),
ay AS (SELECT *, [x FOR x IN [
  CASE WHEN failed THEN {{'code': 'ai_processing_failed', 'severity': 'critical'}} END,
  CASE WHEN NOT policy_confirmed THEN CASE WHEN overall = 'none' THEN {{'code': 'no_policy_match', 'severity': 'critical'}}
    WHEN overall = 'possible' AND candidates > 1 THEN {{'code': 'multiple_policy_matches', 'severity': 'warning'}}
    WHEN overall IN ('high', 'possible') THEN {{'code': 'unconfirmed_policy_match', 'severity': 'warning'}} END END,
  CASE WHEN date_of_loss > received_at THEN {{'code': 'future_loss_date', 'severity': 'critical'}} END,
  CASE WHEN len({_CONFLICTS}) > 0 THEN {{'code': 'conflicting_dates', 'severity': 'warning'}} END,
  CASE WHEN policy_id IS NOT NULL AND date_of_loss::DATE NOT BETWEEN effective_date AND expiry_date THEN {{'code': 'outside_policy_period', 'severity': 'critical'}} END,
  CASE WHEN limit_minor <> 0 AND estimated_loss_minor > limit_minor THEN {{'code': 'exceeds_policy_limit', 'severity': 'warning'}} END,
  CASE WHEN len(gone) > 0 THEN {{'code': 'missing_critical_information', 'severity': 'critical'}} END,
  CASE WHEN case_id % 5 = 0 THEN {{'code': 'possible_duplicate', 'severity': CASE WHEN 0.6::DOUBLE + (case_id % 4) * 0.1::DOUBLE >= 0.85 THEN 'critical' ELSE 'warning' END}} END,
  CASE WHEN top >= 2 THEN {{'code': 'high_severity', 'severity': 'warning'}} END,
  CASE WHEN level <> 'low' THEN {{'code': 'fraud_indicator', 'severity': 'warning'}} END,
  CASE WHEN indicator = 'review_required' THEN {{'code': 'coverage_issue', 'severity': 'warning'}} WHEN indicator = 'possible_exclusion' THEN {{'code': 'coverage_issue', 'severity': 'critical'}} END,
  CASE WHEN case_id % 43 = 0 AND case_id % 86 <> 0 THEN {{'code': 'cat_match', 'severity': 'info'}} END,
  CASE WHEN (case_id % 10) / 10.0::DOUBLE < 0.6 AND NOT failed THEN {{'code': 'low_extraction_confidence', 'severity': 'warning'}} END,
  CASE WHEN case_id % 9 = 0 THEN {{'code': 'document_unreadable', 'severity': 'info'}} END] IF x IS NOT NULL] AS raised FROM ax),
az AS (SELECT *, [x.code FOR x IN raised] AS codes FROM ay)"""

_W = ASSIGNMENT_WEIGHTS
_RANKED = "CASE {} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"
_HANDLERS = oracle_with("cases", "policies", "handlers") + _P + _fraud_sql("wp") + _TRIAGE + f""",
dm AS (SELECT DISTINCT team, required_skill, severity, line_of_business, loss_country AS country FROM te),
hx AS (SELECT dm.*, handler_id, full_name, h.team AS own_team,
  CASE WHEN required_skill IS NOT NULL THEN coalesce(list_contains(string_split(skills, ','), required_skill), false)::INT::DOUBLE END AS p1,
  CASE WHEN h.team = dm.team THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS p2,
  CASE WHEN line_of_business IS NOT NULL AND lines IS NOT NULL THEN CASE WHEN list_contains(string_split(lines, ','), line_of_business) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END END AS p3,
  CASE WHEN dm.country IS NOT NULL AND countries IS NOT NULL THEN CASE WHEN lower(countries) = lower(dm.country) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END END AS p4,
  CASE WHEN severity IS NOT NULL THEN (coalesce({_RANKED.format("max_severity")}, 1) >= {_RANKED.format("severity")})::INT::DOUBLE END AS p5,
  greatest(0::DOUBLE, 1 - open_claims::DOUBLE / greatest(1, capacity)) AS p6, open_claims >= capacity AS full_ FROM dm, handlers h WHERE active),
hy AS (SELECT *, round({d.mean({"p1": _W["skill"], "p2": _W["team"], "p3": _W["line"], "p4": _W["country"], "p5": _W["authority"], "p6": _W["capacity"]})}, 4) AS score,
  coalesce(p1 = 0, false) OR coalesce(p5 = 0, false) OR full_ AS blocked FROM hx)"""

#: Claims one after the other, each taking the first place of its demand's list that nobody took before it.
_TURNS = _HANDLERS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
dn AS (SELECT *, row_number() OVER () AS dno FROM dm),
pl AS (SELECT dno, handler_id, load, round({d.mean({"p1": _W["skill"], "p2": _W["team"], "p3": _W["line"], "p4": _W["country"], "p5": _W["authority"], "p6": _W["capacity"]})}, 4) AS score, full_name FROM (
  SELECT dno, h.handler_id, h.full_name, x.load, p1, p2, p3, p4, p5, 1 - x.load::DOUBLE / greatest(1, h.capacity) AS p6
  FROM hy JOIN dn ON hy.team = dn.team AND hy.required_skill IS NOT DISTINCT FROM dn.required_skill AND hy.severity IS NOT DISTINCT FROM dn.severity
    AND hy.line_of_business IS NOT DISTINCT FROM dn.line_of_business AND hy.country IS NOT DISTINCT FROM dn.country
  JOIN handlers h ON h.handler_id = hy.handler_id, LATERAL (SELECT unnest(range(h.open_claims, h.capacity)) AS load) x WHERE NOT blocked)),
lists AS MATERIALIZED (SELECT dno, list({{'h': handler_id, 'l': load, 's': score}} ORDER BY score DESC, full_name, handler_id, load) AS ranked FROM pl GROUP BY dno),
turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'standard' THEN 2 ELSE 3 END, received_at, case_id) AS n, case_id, ranked
  FROM te JOIN dn ON te.team = dn.team AND te.required_skill IS NOT DISTINCT FROM dn.required_skill AND te.severity IS NOT DISTINCT FROM dn.severity
    AND te.line_of_business IS NOT DISTINCT FROM dn.line_of_business AND te.loss_country IS NOT DISTINCT FROM dn.country JOIN lists USING (dno)),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS case_id, []::BIGINT[] AS taken, NULL::STRUCT(h BIGINT, l BIGINT, s DOUBLE) AS place
  UNION ALL
  SELECT n, case_id, CASE WHEN place IS NULL THEN taken ELSE list_append(taken, place.h * 1000 + place.l) END, place FROM (
    SELECT t.n, t.case_id, w.taken, [p FOR p IN t.ranked IF NOT list_contains(w.taken, p.h * 1000 + p.l)][1] AS place FROM walk w JOIN turns t ON t.n = w.n + 1)),
done AS (SELECT te.case_id AS claim_id, place.h AS handler_id, place.l::INT AS open_before, place.s AS score,
    CASE WHEN place IS NULL THEN 'queue' WHEN required_skill IS NOT NULL THEN 'skill_based' ELSE 'workload' END AS strategy
  FROM te LEFT JOIN (SELECT * FROM walk WHERE place IS NOT NULL) w USING (case_id))"""

ORACLES = {
    "completeness": oracle_with("cases", "fields") + _SURE + f""", f AS ({_FIELDS}),
g AS (SELECT f.*, coalesce(s.confidence < 0.6, false) AS unsure FROM f LEFT JOIN sure s USING (case_id, path))
SELECT case_id, round(sum(CASE WHEN present THEN (CASE WHEN critical THEN 3.0 ELSE 1.0 END) * (CASE WHEN unsure THEN 0.5 ELSE 1 END) ELSE 0 END)::DOUBLE / sum(CASE WHEN critical THEN 3.0 ELSE 1.0 END)::DOUBLE, 4) AS score,
  coalesce(string_agg(path, ',' ORDER BY n) FILTER (WHERE NOT present), '') AS missing, coalesce(string_agg(path, ',' ORDER BY n) FILTER (WHERE NOT present AND critical), '') AS missing_critical,
  coalesce(string_agg(path, ',' ORDER BY n) FILTER (WHERE present AND unsure), '') AS uncertain FROM g GROUP BY case_id""",
    "conflicts": oracle_with("cases") + f" SELECT case_id, unnest({_CONFLICTS}) AS path FROM cases",
    "severity_bands": _WP + _severity("case_id % 43 = 0") + """
SELECT case_id, (['low', 'medium', 'high', 'critical'])[top + 1] AS severity, round(least(0.95::DOUBLE, (CASE WHEN estimated_loss_minor IS NULL THEN 0.35 ELSE 0.7 END)::DOUBLE + hits * 0.05::DOUBLE), 2) AS confidence,
  concat_ws(',', CASE WHEN estimated_loss_minor IS NULL THEN 'no_estimate' ELSE 'estimated_loss' END, CASE WHEN e1 THEN 'fatalities' END, CASE WHEN e2 THEN 'multiple_injuries' END, CASE WHEN e3 THEN 'injuries' END,
    CASE WHEN business_interruption THEN 'business_interruption' END, CASE WHEN structural_damage THEN 'structural_damage' END, CASE WHEN environmental_exposure THEN 'environmental_exposure' END,
    CASE WHEN potential_litigation THEN 'litigation' END, CASE WHEN e8 THEN 'catastrophe' END, CASE WHEN near THEN 'near_policy_limit' END) AS factors FROM sw""",
    "fraud_scores": _WP + _fraud_sql("wp") + " SELECT case_id, level, round(risk, 4) AS score, array_to_string([i.code FOR i IN found], ',') AS indicators FROM fl",
    "coverage_verdict": _WP + _coverage_sql("wp") + """ SELECT case_id, indicator, cover_confidence AS confidence, CASE WHEN policy_id IS NOT NULL THEN c_force END AS in_force,
  CASE WHEN policy_id IS NOT NULL THEN c_peril END AS peril, CASE WHEN policy_id IS NOT NULL THEN c_limit END AS "limit", CASE WHEN policy_id IS NOT NULL THEN c_place END AS location,
  CASE WHEN policy_id IS NOT NULL THEN c_status END AS status FROM cv""",
    "classify_line": oracle_with("cases") + _classify("concat_ws(' ', loss_description, affected_assets)", "(CASE WHEN case_id % 2 = 0 THEN line_of_business END)") + " SELECT case_id, line, sure AS confidence, best AS score FROM kc",
    "classify_reconcile": oracle_with("cases") + _classify("loss_description", None) + f""", kd AS (SELECT *, CASE WHEN case_id % 5 = 0 THEN 'x' ELSE line_of_business END AS told, 0.4::DOUBLE + (case_id % 6) * 0.1::DOUBLE AS own FROM kc)
SELECT case_id, CASE WHEN told IN ({d.quoted(LINE_KEYWORDS)}) THEN told ELSE line END AS line,
  round(CASE WHEN told IN ({d.quoted(LINE_KEYWORDS)}) THEN CASE WHEN line <> 'unknown' AND line <> told AND sure >= 0.6 THEN least(own, 0.55::DOUBLE) ELSE own END ELSE sure END, 4) AS confidence FROM kd""",
    "triage_routes": _WP + _fraud_sql("wp") + _TRIAGE + " SELECT case_id, array_to_string(categories, ',') AS categories, route, team, required_skill, priority, round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.5::DOUBLE * heavy), 2) AS confidence FROM te",
    "exceptions_raised": _ASSESSED + f", r AS (SELECT case_id, unnest(raised) AS x FROM az) SELECT case_id, x.code AS code, x.severity AS severity, x.code IN ({d.quoted(BLOCKING_CODES)}) AS blocking FROM r",
    "derived_status": _ASSESSED + f""" SELECT case_id, status, CASE WHEN status IN ('claim_created', 'rejected', 'cancelled', 'referred') THEN status WHEN failed THEN 'ai_processing_failed'
  {" ".join(f"WHEN list_contains(codes, '{c}') THEN '{s}'" for c, s in STATUS_FOR_CODE)} ELSE 'ready_for_claim' END AS new_status FROM az""",
    "claim_blockers": _ASSESSED + f""" SELECT case_id, array_to_string([c FOR c IN [{d.quoted(BLOCKING_CODES)}] IF list_contains(codes, c)] ||
  [x FOR x IN [CASE WHEN policy_id IS NULL THEN 'policy' END, CASE WHEN coalesce(trim(insured_name), '') = '' THEN 'insured_name' END, CASE WHEN date_of_loss IS NULL THEN 'date_of_loss' END,
  CASE WHEN coalesce(trim(loss_description), '') = '' THEN 'loss_description' END] IF x IS NOT NULL], ',') AS blockers FROM az""",
    "claims_created": oracle_with("cases", "claims") + """ SELECT case_id, 'CLM-' || year(received_at)::VARCHAR || '-' || lpad((row_number() OVER (PARTITION BY year(received_at) ORDER BY received_at, case_id))::VARCHAR, 6, '0') AS claim_reference,
  insured_name, coalesce(estimated_loss_minor, 0) AS reserve_minor, severity FROM cases WHERE status = 'ready_for_claim' AND policy_confirmed AND case_id NOT IN (SELECT claim_id FROM claims)""",
    "lifecycle_transitions": oracle_with("cases") + ", s AS (SELECT DISTINCT status FROM cases), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, v in TRANSITIONS.items() for b in v)
    + ") v(a, b)) SELECT x.status AS current, y.status AS target, x.status = y.status OR EXISTS (SELECT 1 FROM t WHERE a = x.status AND b = y.status) AS allowed FROM s x, s y",
    "handler_scores": _HANDLERS + " SELECT team, required_skill, severity, line_of_business, country, handler_id, score, blocked FROM hy",
    "assignment": _HANDLERS + """, hz AS (SELECT *, row_number() OVER w AS place, lead(blocked) OVER w AS nb, lead(score) OVER w AS ns FROM hy
  WINDOW w AS (PARTITION BY team, required_skill, severity, line_of_business, country ORDER BY blocked, score DESC, full_name, handler_id))
SELECT te.case_id AS claim_id, CASE WHEN NOT blocked THEN handler_id END AS handler_id, te.team || ' queue' AS queue, CASE WHEN blocked THEN 'queue' WHEN te.required_skill IS NOT NULL THEN 'skill_based' ELSE 'workload' END AS strategy,
  CASE WHEN NOT blocked THEN floor((least(9500, 5000 + round(score * 10000)::BIGINT - round(coalesce(CASE WHEN NOT nb THEN ns END, 0) * 10000)::BIGINT) + 50) / 100.0::DOUBLE) / 100.0::DOUBLE ELSE 0::DOUBLE END AS confidence,
  (SELECT coalesce(string_agg(o.handler_id::VARCHAR, ',' ORDER BY o.place), '') FROM hz o WHERE o.team = hz.team AND o.required_skill IS NOT DISTINCT FROM hz.required_skill
    AND o.severity IS NOT DISTINCT FROM hz.severity AND o.line_of_business IS NOT DISTINCT FROM hz.line_of_business AND o.country IS NOT DISTINCT FROM hz.country
    AND CASE WHEN hz.blocked THEN o.place <= 3 ELSE o.place BETWEEN 2 AND 4 AND NOT o.blocked END) AS alternates
FROM te JOIN hz ON place = 1 AND te.team = hz.team AND te.required_skill IS NOT DISTINCT FROM hz.required_skill AND te.severity IS NOT DISTINCT FROM hz.severity
  AND te.line_of_business IS NOT DISTINCT FROM hz.line_of_business AND te.loss_country IS NOT DISTINCT FROM hz.country""",
    "assignment_with_load": _TURNS + " SELECT * FROM done",
    "handler_load_after": _TURNS + """, tk AS (SELECT handler_id, count(*) AS taken FROM done WHERE handler_id IS NOT NULL GROUP BY handler_id)
SELECT handler_id, open_claims AS open_before, coalesce(taken, 0) AS taken, open_claims + coalesce(taken, 0) AS open_after, capacity FROM handlers LEFT JOIN tk USING (handler_id)""",
    "over_authority": oracle_with("claims", "handlers") + " SELECT claim_id, handler_id, reserve_minor - authority_minor AS excess_minor FROM claims JOIN handlers USING (handler_id) WHERE reserve_minor > authority_minor",
}
QUERIES = {name: globals()[name] for name in ORACLES}
