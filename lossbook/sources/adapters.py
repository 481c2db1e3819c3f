"""Claims tables derived from the generic driver tables by arithmetic on keys.

Each adapter is one SELECT in SQL that Spark and other engines read alike;
``{name}`` stands for a source table. ``AS_OF`` is the fixed moment "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossbook.vocab import STATUSES

AS_OF = "2001-08-02 00:00:00"

_LINE = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'motor' WHEN 'BUILDING' THEN 'property' WHEN 'FURNITURE' THEN 'marine'
            WHEN 'HOUSEHOLD' THEN 'liability' ELSE 'engineering' END"""
_LAT = "CAST(5 * n_nationkey - 60 AS DOUBLE)"
_LON = "CAST(10 * n_nationkey - 120 AS DOUBLE)"


def _pick(key: str, values: list[str | None]) -> str:
    rows = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {rows} END"


DESCRIPTIONS = [
    "A fire in the warehouse spread to the roof and the sprinkler system failed",
    "Flood water entered the premises after the river burst its banks",
    "The van was hit in a collision and the driver was hospitalised",
    "Cargo in the container was damaged during the voyage to port",
    "Storm and high winds took part of the building",
    "A letter of claim from the claimant solicitor alleges negligence",
    "Ransomware encrypted the systems and a data breach is suspected",
    "The boiler and the turbine in the plant broke down",
    "Theft of stock",
    None,
]

POLICIES = f"""
SELECT CAST(c_custkey AS BIGINT) AS policy_id,
  'POL-' || CAST(1995 + c_custkey % 6 AS STRING) || '-' || lpad(CAST(c_custkey AS STRING), 6, '0') AS policy_number,
  c_name AS insured_name, CASE WHEN c_custkey % 6 = 0 THEN c_name || ' Holdings' END AS insured_organisation,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 50 AS STRING) || '.example.com' END AS insured_email,
  'Brk' || lpad(CAST(c_custkey % 4999 AS STRING), 4, '0') || ' Partners' AS broker_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'BR-brk' || lpad(CAST((c_custkey + 3) % 4999 AS STRING), 4, '0') || ' brokers/' || CAST(c_custkey % 10 AS STRING) END AS broker_reference,
  {_LINE} AS line_of_business,
  CASE WHEN c_custkey % 11 = 0 THEN 'lapsed' ELSE 'active' END AS status,
  CAST(DATE '1995-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 1200 AS INT) AS DATE) AS effective_date,
  CAST(DATE '1995-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 1200 + 365 * (1 + c_custkey % 5) AS INT) AS DATE) AS expiry_date,
  CAST(round(abs(c_acctbal) * 100) AS BIGINT) * 50 AS limit_minor, CAST(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 50000 END AS BIGINT) AS deductible_minor,
  'Unit ' || CAST(c_custkey % 90 AS STRING) || ', ' || n_name AS primary_location, n_name AS country, r_name AS region,
  {_pick("c_custkey", ["fire,flood,storm", "collision,theft", "fire,explosion", "flood", None])} AS perils,
  {_pick("c_custkey", ["terrorism,war", "flood", "theft", None, "wear and tear", "ransomware", "negligence"])} AS exclusions
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

CASES = f"""
SELECT k AS case_id, custkey, 'FNOL-' || CAST(year(received_at) AS STRING) || '-' || lpad(CAST(k AS STRING), 6, '0') AS reference,
  {_pick("k", list(STATUSES))} AS status,
  {_pick("k", ["email", "portal", "phone", "api", "broker"])} AS channel,
  {_pick("k", ["low", "medium", "high", "critical", "medium", None, "low"])} AS severity,
  CASE WHEN k % 3 = 0 THEN NULL ELSE k % 100 END AS assigned_to,
  received_at,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 97 = 0 THEN received_at + INTERVAL '1' DAY * CAST(49 - k % 47 AS INT)
       ELSE received_at - INTERVAL '1' DAY * CAST(k % 47 AS INT) END AS date_of_loss,
  CASE CAST(k % 4 AS INT) WHEN 0 THEN number WHEN 1 THEN lower(number) WHEN 2 THEN replace(number, '-', ' ') END AS policy_number,
  CASE WHEN k % 11 = 0 THEN true ELSE false END AS policy_confirmed,
  c_name || CASE CAST(k % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN ' Ltd' ELSE ' Limited' END AS insured_name,
  CASE WHEN k % 6 = 0 THEN c_name || ' Group' END AS insured_organisation,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'Brk' || lpad(CAST(custkey % 4999 AS STRING), 4, '0') || ' Brokers' END AS reporter_organisation,
  CASE WHEN k % 9 = 0 THEN NULL ELSE 'Reporter ' || CAST(k % 101 AS STRING) END AS reporter_name,
  CASE CAST(k % 3 AS INT) WHEN 0 THEN 'C' || CAST(custkey AS STRING) || '@mail' || CAST(custkey % 50 AS STRING) || '.example.com'
       WHEN 1 THEN 'ops@mail' || CAST(custkey % 50 AS STRING) || '.example.com' END AS reporter_email,
  CASE WHEN k % 29 = 0 THEN NULL ELSE 'Unit ' || CAST(custkey % 90 AS STRING) || ' Mill Road, ' || n_name END AS loss_location,
  CASE WHEN k % 31 = 0 THEN NULL ELSE n_name END AS loss_country,
  CASE WHEN k % 4 = 1 THEN NULL ELSE {_LAT} + (k % 10) * 0.25 END AS loss_latitude,
  CASE WHEN k % 4 = 1 THEN NULL ELSE {_LON} + (k % 7) * 0.25 END AS loss_longitude,
  {_pick("k", DESCRIPTIONS)} AS loss_description,
  {_pick("k", ["fire", "flood", None, "theft", "storm", "collision", "explosion"])} AS cause_of_loss,
  {_pick("k", ["fire", "flood", "theft", None])} AS loss_type,
  {_pick("k", ["stock and racking", "vehicle AB12 CDE", None, "vessel and cargo"])} AS affected_assets,
  {_pick("k", [None, "Police", None, "County court officer", None, "Fire service", None, None, None])} AS authorities_involved,
  {_pick("k", [None, "Please find the notice enclosed.", None, "We enclose a letter of claim.", "The driver is in intensive care.", None, None, "See below.", None, None, None])} AS source_body,
  CASE WHEN k % 6 = 5 THEN NULL ELSE {_LINE} END AS line_of_business,
  CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k % 5 AS INT) END AS injuries, CASE WHEN k % 211 = 0 THEN 1 ELSE 0 END AS fatalities,
  k % 13 = 0 AS business_interruption, k % 17 = 0 AS structural_damage, k % 19 = 0 AS environmental_exposure, k % 37 = 0 AS potential_litigation,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) * (1 + k % 3) END AS estimated_loss_minor,
  CASE WHEN k % 2 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) * (k % 12) END AS repair_estimate_minor,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'PR' || CAST(k AS STRING) END AS police_reference,
  CASE WHEN k % 5 = 0 THEN 'IR' || CAST(k AS STRING) END AS incident_reference,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 'EXT/' || CAST(custkey AS STRING) || '/' || CAST(k % 3 AS STRING) END AS external_reference,
  k % 4 AS documents, k % 10 = 3 AS third_parties, k % 8 = 2 AS witnesses
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS custkey, o_totalprice,
        o_orderdate + INTERVAL '1' MINUTE * CAST(o_orderkey % 1440 AS INT) AS received_at,
        'POL-' || CAST(1995 + o_custkey % 6 AS STRING) || '-' || lpad(CAST(o_custkey AS STRING), 6, '0') AS number
      FROM {{orders}}) o
  JOIN {{customer}} ON custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

CLAIMS = """
SELECT CAST(o_orderkey AS BIGINT) AS claim_id, 'CLM-' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(o_orderkey AS STRING), 6, '0') AS reference,
  CAST(o_custkey AS BIGINT) AS custkey,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'open' WHEN 1 THEN 'in_review' WHEN 2 THEN 'pending_information' WHEN 3 THEN 'approved'
       WHEN 4 THEN 'rejected' ELSE 'open' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'standard' ELSE 'routine' END AS priority,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' END AS severity,
  o_orderdate AS reported_at, CAST(round(o_totalprice * 100) AS BIGINT) AS reserve_minor,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
  o_orderkey % 7 = 0 AS fraud_review, o_orderkey % 13 = 0 AS over_authority, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 25 END AS cat_event_id,
  o_orderkey % 100 AS handler_id, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS insured_name,
  'POL-' || CAST(1995 + o_custkey % 6 AS STRING) || '-' || lpad(CAST(o_custkey AS STRING), 6, '0') AS policy_number,
  o_orderdate - INTERVAL '1' DAY * CAST(o_orderkey % 47 AS INT) AS date_of_loss,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'escape_of_water' WHEN 1 THEN 'fire' WHEN 2 THEN 'theft' END AS loss_type
FROM {orders} WHERE o_orderstatus = 'F'
"""

HANDLERS = """
SELECT CAST(s_suppkey AS BIGINT) AS handler_id, s_name AS full_name,
  CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 'SIU' WHEN 1 THEN 'Litigation' WHEN 2 THEN 'Major Loss' WHEN 3 THEN 'CAT Response' WHEN 4 THEN 'Specialist'
       WHEN 5 THEN 'Complex' ELSE 'Fast Track' END AS team,
  CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'fraud_investigation,litigation' WHEN 1 THEN 'major_loss' WHEN 2 THEN 'catastrophe,major_loss' WHEN 3 THEN 'litigation' END AS skills,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'property,motor' WHEN 1 THEN 'marine,engineering' WHEN 2 THEN 'liability,property,motor' END AS lines,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE n_name END AS countries,
  CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'unknown' END AS max_severity,
  CAST(10 + s_suppkey % 20 AS INT) AS capacity, CAST(s_suppkey % 30 AS INT) AS open_claims, CAST(round(abs(s_acctbal) * 10000) AS BIGINT) AS authority_minor,
  s_suppkey % 10 <> 9 AS active
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

EVENTS = f"""
SELECT CAST(n_nationkey AS INT) AS event_id, 'CAT-' || CAST(1995 + n_nationkey % 7 AS STRING) || '-' || lpad(CAST(n_nationkey AS STRING), 3, '0') AS reference,
  {_pick("n_nationkey", ["flood", "storm", "wildfire", "industrial"])} AS event_type,
  {_pick("n_nationkey", ["flood,storm", "storm", "wildfire,hail", "industrial,fire", None])} AS perils,
  CAST(DATE '1995-01-01' + INTERVAL '1' DAY * CAST(90 * n_nationkey AS INT) AS DATE) AS start_date,
  CAST(DATE '1995-01-01' + INTERVAL '1' DAY * CAST(90 * n_nationkey + 20 AS INT) AS DATE) AS end_date,
  n_name AS country, r_name AS region, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Mill,' || n_name END AS areas,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {_LAT} END AS latitude, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {_LON} END AS longitude,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(120 AS DOUBLE) END AS radius_km
FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
"""

EXCEPTIONS = """
SELECT CAST(l_orderkey AS BIGINT) AS case_id,
  CASE CAST(l_partkey % 16 AS INT) WHEN 0 THEN 'no_policy_match' WHEN 1 THEN 'multiple_policy_matches' WHEN 2 THEN 'unconfirmed_policy_match'
    WHEN 3 THEN 'possible_duplicate' WHEN 4 THEN 'missing_critical_information' WHEN 5 THEN 'high_severity' WHEN 6 THEN 'fraud_indicator'
    WHEN 7 THEN 'coverage_issue' WHEN 8 THEN 'cat_match' WHEN 9 THEN 'low_extraction_confidence' WHEN 10 THEN 'conflicting_dates'
    WHEN 11 THEN 'future_loss_date' WHEN 12 THEN 'outside_policy_period' WHEN 13 THEN 'exceeds_policy_limit' WHEN 14 THEN 'ai_processing_failed'
    ELSE 'document_unreadable' END AS code,
  CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'resolved' END AS status, l_shipdate AS created_at
FROM {lineitem}
"""

FIELDS = """
SELECT CAST(l_orderkey AS BIGINT) AS case_id, CAST(l_linenumber AS INT) AS field_no, max(CAST(l_partkey AS STRING)) AS value,
  max(l_discount * 10) AS confidence, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS human_modified, min(l_suppkey) AS evidence
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

#: Edits of officers: a log with texts as people type them, some about fields that can't be edited.
EDITS = """
SELECT CAST(l_orderkey AS BIGINT) * 8 + CAST(l_linenumber AS BIGINT) AS change_id, CAST(l_orderkey AS BIGINT) AS case_id,
  CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'loss.injuries' WHEN 1 THEN 'financial.estimated_loss' WHEN 2 THEN 'loss.loss_country' WHEN 3 THEN 'loss.structural_damage'
    WHEN 4 THEN 'loss.loss_country' WHEN 5 THEN 'notification.reporter_email' ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'policy.limit' ELSE 'loss.injuries' END END AS path,
  CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN CAST(l_suppkey % 3 AS STRING) WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'much' ELSE 'GBP ' || CAST(l_suppkey % 9 AS STRING) || 'k' END
    WHEN 2 THEN '  FRANCE ' WHEN 3 THEN CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN '' ELSE 'perhaps' END
    WHEN 4 THEN CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'SPAIN' END WHEN 5 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'nobody' ELSE 'Ann' || CAST(l_suppkey % 7 AS STRING) || '@Mail.Example.com' END
    ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'none' ELSE '2 people' END END AS raw,
  l_shipdate + INTERVAL '1' MINUTE * CAST(l_partkey % 600 AS INT) AS moment, 'officer' || CAST(l_suppkey % 40 AS STRING) AS actor, CASE WHEN l_linenumber % 2 = 0 THEN 'call ' || l_returnflag END AS reason
FROM {lineitem}
"""

ADAPTERS = {
    "policies": POLICIES, "cases": CASES, "claims": CLAIMS, "handlers": HANDLERS, "cat_events": EVENTS, "exceptions": EXCEPTIONS, "fields": FIELDS, "edits": EDITS,
}
SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


#: Keys by which the rows of large sources are dealt.
DEALT = {"orders": "o_orderkey"}


def load(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A claims table over the driver tables in sf_dir; dealt: its rows over as many tasks as shuffles have, however few pieces the files come in, for work that takes long for each row."""
    text = ADAPTERS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f"{{{t}}}" in text}
    if dealt:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables = {t: df.repartition(tasks, DEALT[t]) if t in DEALT else df for t, df in tables.items()}
    return spark.sql(text, **tables)


def oracle_with(*names: str) -> str:
    """The same tables as common table expressions over plain table names."""
    return "WITH " + ",\n".join(f"{n} AS ({ADAPTERS[n].format(**{t: t for t in SOURCES})})" for n in names)
