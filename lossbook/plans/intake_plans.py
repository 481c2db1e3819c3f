"""Queries of intake, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossbook.operators import intake
from lossbook.plans.notice_plans import BODY
from lossbook.sources.adapters import load, oracle_with

#: Messages of the event stream: a sender's key for what it sends about one thing, and the id of the mail it came in.
MESSAGES = """SELECT CAST(event_id AS BIGINT) AS row_id, ts AS moment,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(user_id AS STRING) || '-' || event_type END AS idempotency_key,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'mail-' || CAST(event_id % 2999 AS STRING) || '@' || CAST(user_id % 5 AS STRING) END AS message_id FROM {events}"""
BUDGET, ROUNDS = 6000, 14


def intake_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.first_deliveries(spark.sql(MESSAGES, events=spark.read.parquet(f"{sf_dir}/events.parquet")))


def corpus_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with the documents that came with them, four a case."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id div 4 AS n", "doc_id % 4 AS nth", "text")
    cases = load(spark, sf_dir, "cases").selectExpr("case_id", f"{BODY} AS notice")
    got = intake.budgeted(cases, documents.withColumnRenamed("n", "case_id"), BUDGET)
    return got.selectExpr("case_id", "n_attachments", "CAST(length(corpus) AS BIGINT) AS n_chars", "md5(corpus) AS corpus_md5")


def _rounds() -> str:
    """Each round takes, of the messages left, those that are first for both their key and their id; then nothing that shares with them is left."""
    steps = ["w0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY moment, row_id) AS turn FROM m)"]
    for n in range(ROUNDS):
        steps.append(
            f"c{n} AS MATERIALIZED (SELECT * EXCLUDE (k1, k2) FROM (SELECT *, min(turn) OVER (PARTITION BY idempotency_key) AS k1, min(turn) OVER (PARTITION BY message_id) AS k2 FROM w{n}) "
            "WHERE (idempotency_key IS NULL OR turn = k1) AND (message_id IS NULL OR turn = k2))"
        )
        steps.append(
            f"w{n + 1} AS MATERIALIZED (SELECT w.* FROM w{n} w WHERE turn NOT IN (SELECT turn FROM c{n}) AND NOT EXISTS (SELECT 1 FROM c{n} c WHERE c.idempotency_key = w.idempotency_key) "
            f"AND NOT EXISTS (SELECT 1 FROM c{n} c WHERE c.message_id = w.message_id))"
        )
    made = " UNION ALL ".join(f"SELECT * FROM c{n}" for n in range(ROUNDS))
    return ", ".join(steps) + f", made AS MATERIALIZED ({made})"


def _shares() -> str:
    """Four attachments, one after the other."""
    steps, left = [], f"greatest(0, {BUDGET} - length(notice))"
    for k in range(4):
        steps.append(f"s{k} AS (SELECT *, {left} AS l{k}, CASE WHEN {left} > 0 AND n > {k} THEN least(length(texts[{k + 1}]), greatest(2000, {left} // n)) END AS p{k} FROM {'h' if k == 0 else f's{k - 1}'})")
        left = f"(l{k} - coalesce(p{k}, 0))"
    return ", ".join(steps)


ORACLES = {
    "intake_redelivery": "WITH m AS (" + MESSAGES.format(events="events") + "), " + _rounds() + f"""
SELECT w.row_id, c.row_id IS NOT NULL AS created, CASE WHEN c.row_id IS NULL THEN coalesce((SELECT arg_min(x.row_id, x.turn) FROM made x WHERE x.idempotency_key = w.idempotency_key AND x.turn < w.turn),
  (SELECT arg_min(x.row_id, x.turn) FROM made x WHERE x.message_id = w.message_id AND x.turn < w.turn)) END AS existing
FROM w0 w LEFT JOIN made c ON c.row_id = w.row_id WHERE (SELECT count(*) FROM w{ROUNDS}) = 0""",
    "corpus_budget": oracle_with("cases") + f""",
d AS (SELECT doc_id // 4 AS case_id, list(coalesce(text, '') ORDER BY doc_id % 4) AS texts FROM documents GROUP BY doc_id // 4),
h AS (SELECT case_id, trim(coalesce({BODY}, ''), ' ' || chr(9) || chr(10) || chr(13)) AS notice, coalesce(texts, []) AS texts, coalesce(len(texts), 0) AS n FROM cases LEFT JOIN d USING (case_id)),
{_shares()},
z AS (SELECT case_id, notice || {" || ".join(f"CASE WHEN p{k} IS NULL THEN '' ELSE chr(10) || chr(10) || '--- ATTACHMENT {k + 1} ---' || chr(10) || left(texts[{k + 1}], p{k}::BIGINT) END" for k in range(4))} AS corpus,
  {" + ".join(f"(p{k} IS NOT NULL)::INT" for k in range(4))} AS n_attachments FROM s3)
SELECT case_id, n_attachments, length(corpus) AS n_chars, md5(corpus) AS corpus_md5 FROM z""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
