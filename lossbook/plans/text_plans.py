"""Queries of parsing, extraction, merging and graph building, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.functions import parsing, text
from lossbook.operators import graph, merge
from lossbook.plans import dialect as d
from lossbook.sources import documents
from lossbook.sources.adapters import load, oracle_with
from lossbook.vocab import LINE_ALIASES, LINES

_DATES = """CASE CAST(case_id % 8 AS INT) WHEN 0 THEN {iso} WHEN 1 THEN {d}||'/'||{m}||'/'||{y} WHEN 2 THEN {d}||'-'||{m}||'-'||{y} WHEN 3 THEN {d}||'.'||{m}||'.'||{y}
  WHEN 4 THEN {d}||'th August '||{y} WHEN 5 THEN 'August '||{d}||', '||{y} WHEN 6 THEN {y}||'/'||{m}||'/'||{d} ELSE '31/02/'||{y} END"""
_PART = {"y": "CAST(year(received_at) AS STRING)", "m": "CAST(month(received_at) AS STRING)", "d": "CAST(day(received_at) AS STRING)", "iso": "CAST(CAST(received_at AS DATE) AS STRING)"}
DATE_TEXT = _DATES.format(**_PART)
MONEY_TEXT = """CASE CAST(case_id % 7 AS INT) WHEN 0 THEN 'GBP ' || CAST(case_id % 999 AS STRING) || ',250' WHEN 1 THEN '£' || CAST(case_id % 97 AS STRING) || 'k'
  WHEN 2 THEN CAST(case_id % 9 AS STRING) || '.4m' WHEN 3 THEN '-' || CAST(case_id AS STRING) WHEN 4 THEN 'no idea' WHEN 5 THEN '$' || CAST(case_id AS STRING) || '.75' ELSE '€ 12 500' END"""
NOTICE = """'Policy number: ' || coalesce(policy_number, 'tbc') || chr(10) || '* Insured - ' || insured_name || chr(10) || 'Date of loss: 2001-03-0' || CAST(1 + case_id % 9 AS STRING)
  || chr(10) || 'Injuries: ' || coalesce(CAST(injuries AS STRING), 'n/a') || chr(10) || 'Contact email: ' || coalesce(reporter_email, '-') || chr(10) || 'Location: ' || coalesce(loss_location, 'unknown')"""


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").selectExpr("case_id", f"{DATE_TEXT} AS t")
    return rows.select("case_id", parsing.parse_date(F.col("t")).cast("string").alias("parsed"))


def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").selectExpr("case_id", f"{MONEY_TEXT} AS t")
    return rows.select("case_id", parsing.parse_money_minor(F.col("t")).alias("minor"), parsing.parse_currency(F.col("t")).alias("currency"))


def parse_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", parsing.parse_email(F.col("text")).alias("email"), parsing.parse_phone(F.col("text")).alias("phone"))


def parse_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "CASE CAST(case_id % 6 AS INT) WHEN 0 THEN upper(line_of_business) WHEN 1 THEN 'Auto ' WHEN 2 THEN 'general liability' WHEN 3 THEN 'spaceflight' WHEN 4 THEN 'Motor-Fleet' END"
    rows = load(spark, sf_dir, "cases").selectExpr("case_id", f"{said} AS t", "CASE WHEN case_id % 2 = 0 THEN 'Escape of Water' ELSE loss_type END AS l", "line_of_business")
    line = parsing.parse_line_of_business(F.col("t"))
    return rows.select("case_id", line.alias("line"), parsing.valid_loss_type(F.col("line_of_business"), F.col("l")).alias("loss_type"))


def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases")
    return rows.select(
        "case_id", text.normalise(F.col("insured_name")).alias("name"), text.normalise_organisation(F.col("insured_organisation")).alias("organisation"),
        text.normalise_reference(F.col("policy_number")).alias("number"), F.lower(text.first_distinctive_word(F.col("reporter_organisation"))).alias("lead"),
    )


def extract_labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").selectExpr("case_id", f"{NOTICE} AS body")
    wanted = {"policy_number": ("policy number", "policy no"), "insured_name": ("insured", "insured name"), "date_of_loss": ("date of loss",), "injuries": ("injuries",), "reporter_email": ("contact email",), "loss_location": ("location",)}
    return rows.select("case_id", *[documents.labelled(F.col("body"), labels).alias(name) for name, labels in wanted.items()])


def longest_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", documents.longest_paragraph(F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).alias("paragraph"))


def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_html(F.col("html")).alias("text"))


def json_flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flat_json(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")


def csv_rows_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "handlers").selectExpr("handler_id", "concat_ws(',', full_name, team, coalesce(max_severity, ''), CASE WHEN handler_id % 3 = 0 THEN '' ELSE CAST(capacity AS STRING) END) AS line")
    return rows.select("handler_id", documents.csv_row_text("name,team,severity,capacity", F.col("line")).alias("text"))


def document_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.sha2("text", 256).alias("checksum"))
    return merge.first_arrivals(docs.withColumn("k", F.concat_ws("/", "source", "checksum")), "k", ("doc_id",)).select("doc_id", "source", "checksum")


def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat_ws("-", "user_id", "event_type").alias("message"))
    known = events.filter("event_id % 50 = 0").select("message").distinct()
    return merge.first_arrivals(events, "message", ("ts", "event_id"), known).select("event_id", "message")


def fingerprint_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("|", "source", "text"), 256).alias("fingerprint"))
    stored = docs.select("id", F.when(F.col("id") % 3 == 0, F.lit("stale")).otherwise(F.col("fingerprint")).alias("fingerprint"), (F.col("id") % 5 != 0).alias("completed")).filter("id % 7 <> 0")
    return merge.memo(docs, stored)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "fields")
    return rows.filter("field_no <= 4"), rows.filter("field_no >= 3").withColumn("value", F.concat(F.lit("new "), "value"))


def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_fields(*_halves(spark, sf_dir))


def merge_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "exceptions").groupBy("case_id", "code").agg(F.min("status").alias("status"))
    old = rows.filter("case_id % 3 <> 0").select("case_id", "code", "status", F.lit("warning").alias("severity"))
    return merge.merge_exceptions(old, rows.filter("case_id % 2 = 0").select("case_id", "code", F.lit("critical").alias("severity")))


def merge_policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").select("case_id", F.col("custkey").alias("policy_id"), (F.col("case_id") % 10 / 10).alias("score"))
    old = rows.filter("case_id % 3 <> 0").withColumn("selected", F.col("case_id") % 4 == 0)
    return merge.merge_policy_matches(old, rows.filter("case_id % 2 = 0").withColumn("score", F.col("score") + 1))


def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").select("case_id", F.col("custkey").alias("other_id"), (F.col("case_id") % 10 / 10).alias("score"))
    old = rows.filter("case_id % 3 <> 0").withColumn("resolution", F.when(F.col("case_id") % 4 == 0, "linked").otherwise("unresolved"))
    return merge.merge_duplicates(old, rows.filter("case_id % 2 = 0").withColumn("score", F.col("score") + 1))


def merge_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "cases").select("case_id", F.lit("insured").alias("role"), F.col("insured_name").alias("name"), F.col("insured_organisation").alias("organisation"), F.col("reporter_email").alias("email"))
    new = rows.filter("case_id % 2 = 0").select("case_id", "role", F.upper("name").alias("name"), F.lit(None).cast("string").alias("organisation"), F.concat(F.lit("new."), "email").alias("email"))
    return merge.merge_parties(rows.filter("case_id % 3 <> 0"), new)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(load(spark, sf_dir, "claims"), load(spark, sf_dir, "policies"), load(spark, sf_dir, "handlers"), load(spark, sf_dir, "cat_events"))[0]


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(load(spark, sf_dir, "claims"), load(spark, sf_dir, "policies"), load(spark, sf_dir, "handlers"), load(spark, sf_dir, "cat_events"))[1]


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(graph_nodes(spark, sf_dir))


_HALVES = """, o AS (SELECT * FROM fields WHERE field_no <= 4), n AS (SELECT * REPLACE ('new ' || value AS value) FROM fields WHERE field_no >= 3)"""
_GRAPH = oracle_with("claims", "policies", "handlers", "cat_events") + """,
j AS (SELECT c.*, p.policy_id, p.primary_location, p.status AS policy_status, h.full_name, h.handler_id AS own_handler, e.event_id, e.reference AS event_reference FROM claims c LEFT JOIN policies p ON c.custkey = p.policy_id
  LEFT JOIN handlers h ON c.handler_id = h.handler_id LEFT JOIN cat_events e ON c.cat_event_id = e.event_id),
nodes AS (SELECT claim_id, 'claim:' || reference AS node_id, 'claim' AS type, reference AS label, CASE WHEN fraud_review THEN 'watch' END AS flag FROM j
  UNION SELECT claim_id, 'policy:' || policy_number, 'policy', policy_number, CASE WHEN policy_status <> 'active' THEN 'watch' END FROM j WHERE policy_id IS NOT NULL
  UNION SELECT claim_id, 'insured:' || insured_name, 'organisation', insured_name, NULL FROM j WHERE policy_id IS NOT NULL
  UNION SELECT claim_id, 'incident:' || claim_id::VARCHAR, 'incident', coalesce(loss_type, 'incident'), NULL FROM j
  UNION SELECT claim_id, 'location:' || primary_location, 'location', primary_location, NULL FROM j WHERE primary_location IS NOT NULL
  UNION SELECT claim_id, 'handler:' || own_handler::VARCHAR, 'person', full_name, NULL FROM j WHERE own_handler IS NOT NULL
  UNION SELECT claim_id, 'event:' || event_reference, 'catastrophe', event_reference, NULL FROM j WHERE event_id IS NOT NULL)"""
ORACLES = {
    "parse_dates": oracle_with("cases") + """ SELECT case_id, CASE WHEN case_id % 8 = 7 THEN NULL WHEN case_id % 8 IN (4, 5) THEN CASE WHEN TRUE THEN make_date(year(received_at), 8, day(received_at))::VARCHAR END
  ELSE received_at::DATE::VARCHAR END AS parsed FROM cases""",
    "parse_money": oracle_with("cases") + """ SELECT case_id, CASE case_id % 7 WHEN 0 THEN (case_id % 999 || '250')::BIGINT * 100 WHEN 1 THEN (case_id % 97) * 100000 WHEN 2 THEN ((case_id % 9) * 10 + 4) * 10000000
  WHEN 5 THEN case_id * 100 + 75 WHEN 6 THEN 1250000 WHEN 3 THEN CASE WHEN case_id = 0 THEN 0 END END::BIGINT AS minor,
  CASE case_id % 7 WHEN 5 THEN 'USD' WHEN 6 THEN 'EUR' ELSE 'GBP' END AS currency FROM cases""",
    "parse_contacts": """SELECT doc_id, nullif(lower(regexp_extract(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\\.[a-zA-Z0-9_.-]+', 0)), '') AS email,
  CASE WHEN length(ltrim(p, '+')) BETWEEN 7 AND 15 THEN p END AS phone FROM (SELECT doc_id, text, regexp_replace(regexp_extract(text, '[+()0-9][0-9\\s()+.-]{6,}[0-9]', 0), '[^0-9+]', '', 'g') AS p FROM documents)""",
    "parse_vocab": oracle_with("cases") + f""", k AS (SELECT *, CASE case_id % 6 WHEN 0 THEN line_of_business WHEN 1 THEN 'motor' WHEN 2 THEN 'liability' WHEN 4 THEN 'motor' END AS line,
  CASE WHEN case_id % 2 = 0 THEN 'escape_of_water' ELSE loss_type END AS l FROM cases)
SELECT case_id, line, CASE WHEN line_of_business = 'property' AND l IN ('fire', 'flood', 'theft', 'escape_of_water') OR line_of_business = 'motor' AND l IN ('fire', 'flood', 'theft') THEN l END AS loss_type FROM k""",
    "normalise_names": oracle_with("cases") + f" SELECT case_id, {d.norm('insured_name')} AS name, {d.org('insured_organisation')} AS organisation, {d.ref('policy_number')} AS number, {d.lead('reporter_organisation')} AS lead FROM cases",
    "extract_labelled_fields": oracle_with("cases") + """ SELECT case_id, policy_number, insured_name, '2001-03-0' || (1 + case_id % 9)::VARCHAR AS date_of_loss, injuries::VARCHAR AS injuries, reporter_email, loss_location FROM cases""",
    "longest_paragraph": r"""WITH p AS (SELECT doc_id, unnest([trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n')]) AS x,
  generate_subscripts(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n'), 1) AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS n FROM p WHERE length(x) > 80 AND NOT contains(left(x, 24), ':'))
SELECT d.doc_id, left(r.x, 2000) AS paragraph FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n = 1""",
    "strip_html_pages": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', ' ', 'gis'), '<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""",
    "json_flatten_props": "SELECT event_id, 'k: ' || (props->>'$.k') AS text FROM events",
    "csv_rows_as_text": oracle_with("handlers") + " SELECT handler_id, concat_ws('; ', 'name: ' || full_name, 'team: ' || team, 'severity: ' || max_severity, CASE WHEN handler_id % 3 <> 0 THEN 'capacity: ' || capacity::VARCHAR END) AS text FROM handlers",
    "document_dedupe": "SELECT doc_id, source, sha256(text) AS checksum FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1",
    "ingest_idempotent": """WITH e AS (SELECT event_id, ts, user_id::VARCHAR || '-' || event_type AS message FROM events)
SELECT event_id, message FROM e WHERE message NOT IN (SELECT message FROM e WHERE event_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY message ORDER BY ts, event_id) = 1""",
    "fingerprint_memo": "SELECT doc_id AS id, sha256(source || '|' || text) AS fingerprint, doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS reuse FROM documents",
    "merge_fields": oracle_with("fields") + _HALVES + """
SELECT case_id, field_no, CASE WHEN o.human_modified OR n.case_id IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN o.human_modified OR n.case_id IS NULL THEN o.confidence ELSE n.confidence END AS confidence,
  coalesce(o.human_modified, false) AS human_modified, coalesce(n.evidence, o.evidence) AS evidence FROM o FULL JOIN n USING (case_id, field_no)""",
    "merge_exceptions": oracle_with("exceptions") + """, r AS (SELECT case_id, code, min(status) AS status FROM exceptions GROUP BY case_id, code), o AS (SELECT * FROM r WHERE case_id % 3 <> 0), n AS (SELECT * FROM r WHERE case_id % 2 = 0)
SELECT case_id, code, coalesce(o.status, 'open') AS status, CASE WHEN n.code IS NOT NULL THEN 'critical' ELSE 'warning' END AS severity FROM o FULL JOIN n USING (case_id, code) WHERE n.case_id IS NOT NULL OR o.status <> 'open'""",
    "merge_policy_matches": oracle_with("cases") + """ SELECT case_id, custkey AS policy_id, (case_id % 10) / 10.0::DOUBLE + CASE WHEN case_id % 2 = 0 THEN 1 ELSE 0 END AS score, case_id % 3 <> 0 AND case_id % 4 = 0 AS selected
FROM cases WHERE case_id % 2 = 0 OR (case_id % 3 <> 0 AND case_id % 4 = 0)""",
    "merge_duplicates": oracle_with("cases") + """ SELECT case_id, custkey AS other_id, (case_id % 10) / 10.0::DOUBLE + CASE WHEN case_id % 2 = 0 THEN 1 ELSE 0 END AS score,
  CASE WHEN case_id % 3 <> 0 AND case_id % 4 = 0 THEN 'linked' ELSE 'unresolved' END AS resolution FROM cases WHERE case_id % 2 = 0""",
    "merge_parties": oracle_with("cases") + """ SELECT case_id, 'insured' AS role, CASE WHEN case_id % 3 <> 0 THEN insured_name ELSE upper(insured_name) END AS name,
  CASE WHEN case_id % 3 <> 0 THEN insured_organisation END AS organisation,
  coalesce(CASE WHEN case_id % 2 = 0 THEN 'new.' || reporter_email END, CASE WHEN case_id % 3 <> 0 THEN reporter_email END) AS email FROM cases WHERE case_id % 2 = 0 OR case_id % 3 <> 0""",
    "graph_nodes": _GRAPH + " SELECT * FROM nodes",
    "graph_edges": _GRAPH + """ SELECT claim_id, 'claim:' || reference AS src, 'COVERED_BY' AS rel, 'policy:' || policy_number AS dst FROM j WHERE policy_id IS NOT NULL
  UNION SELECT claim_id, 'policy:' || policy_number, 'ISSUED_TO', 'insured:' || insured_name FROM j WHERE policy_id IS NOT NULL
  UNION SELECT claim_id, 'claim:' || reference, 'CAUSED_BY', 'incident:' || claim_id::VARCHAR FROM j
  UNION SELECT claim_id, 'incident:' || claim_id::VARCHAR, 'OCCURRED_AT', 'location:' || primary_location FROM j WHERE primary_location IS NOT NULL
  UNION SELECT claim_id, 'claim:' || reference, 'ASSIGNED_TO', 'handler:' || own_handler::VARCHAR FROM j WHERE own_handler IS NOT NULL
  UNION SELECT claim_id, 'incident:' || claim_id::VARCHAR, 'MATCHES', 'event:' || event_reference FROM j WHERE event_id IS NOT NULL""",
    "graph_summary": _GRAPH + """ SELECT claim_id, count(*) AS nodes, count(*) FILTER (WHERE type IN ('organisation', 'person')) AS parties, count(*) FILTER (WHERE flag = 'watch') AS watched FROM nodes GROUP BY claim_id""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
