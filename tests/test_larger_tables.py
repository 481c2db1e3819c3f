"""What only larger tables show."""

from __future__ import annotations

import random

import duckdb

from lossbook.operators import assessment, matching, triage
from lossbook.plans import queue_plans
from lossbook.thresholds import Thresholds


def test_numbers_beyond_six_digits(spark, tmp_path):
    """The millionth notice of a year keeps all its digits, in the query and in its SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, 1::BIGINT AS o_custkey, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * (i % 300)::INT AS o_orderdate FROM range(1000003) t(i)")
    con.execute("CREATE TABLE customer AS SELECT 1::BIGINT AS c_custkey, 'x' AS c_name, 1 AS c_nationkey, 'BUILDING' AS c_mktsegment")
    con.execute("CREATE TABLE nation AS SELECT 1 AS n_nationkey, 'FRANCE' AS n_name, 1 AS n_regionkey")
    for name in ("orders", "customer", "nation"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    long = "length(reference) > 16"
    want = con.execute(f"SELECT case_id, reference FROM ({queue_plans.ORACLES['reference_sequence']}) WHERE {long} ORDER BY 2").fetchall()
    got = queue_plans.reference_sequence(spark, str(tmp_path)).filter(long).orderBy("reference").collect()
    assert [tuple(r) for r in got] == want and [r.reference for r in got] == [f"FNOL-2001-{n}" for n in range(1_000_000, 1_000_004)]


def test_candidates_of_a_broker_with_a_large_book(spark):
    """A broker's policies are one list for all its notices: candidates as by brute force, and no pair is shuffled or sorted."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    names = ["", None, "Acme", "Acme Marine", "Zen\u00e9 Group", "Ox"]
    cases = [(i, pick("P-1", "p 12", "P-123456789012345", None), pick(*names), pick(*names), pick("Big Broker", "big", "Small", None, " "), pick("A@x.com ", "b@x.com", None), None, None, None) for i in range(60)]
    policies = [(i - 5, pick(f"P-12{i % 4}", "P-1234567890123456", None), pick(*names), pick(*names), pick("Big Broker Ltd", "Small Broker", None), pick("BR-big broker/1", None), pick("a@x.com", "b@x.com", None)) for i in range(80)]
    c = spark.createDataFrame(cases, "case_id long, policy_number string, insured_name string, insured_organisation string, reporter_organisation string, reporter_email string, loss_country string, line_of_business string, date_of_loss timestamp_ntz")
    p = spark.createDataFrame(policies, "policy_id long, policy_number string, insured_name string, insured_organisation string, broker_name string, broker_reference string, insured_email string")
    p = p.selectExpr("*", "'motor' line_of_business", "'France' country", "date'2001-01-01' effective_date", "date'2002-01-01' expiry_date")
    found = matching.policy_candidates(c, p, Thresholds(policy_candidates=7))
    forms = c.select("case_id", matching.normalise_reference(c.policy_number), *[matching._lead(c[n]) for n in ("insured_name", "insured_organisation", "reporter_organisation")]).collect()
    held = {r[0]: r[1] for r in p.select("policy_id", matching.sql_normal_form(p.policy_number)).collect()}
    inside = lambda key, value: bool(key) and value is not None and key in value.lower()
    want = set()
    for case, (case_id, number, insured, organisation, broker) in zip(cases, forms, strict=True):
        sender, reporter = (case[5] or "").strip(" ").lower(), (case[4] or "").strip(" ").lower()
        told = number or insured or organisation or broker or sender or reporter
        hits = [
            x for x in policies
            if not told or inside(number, held[x[0]]) or inside(insured, x[2]) or inside(organisation, x[3]) or inside(broker, x[4]) or inside(reporter, x[5]) or (sender and sender == x[6])
        ]
        want |= {(case_id, x[0]) for x in sorted(hits, key=lambda x: (x[1] is not None, x[1] or "", x[0]))[:7]}
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200
    made = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(first")
    assert len(made) == 2 and "Window" not in made[0] and "Aggregate" not in made[0] and "Join" not in made[0]


def test_handlers_alike_are_scored_once(spark, monkeypatch):
    """Scores of each handler as if scored one by one, from as many scored rows for 6 handlers of a kind as for 60; first handlers as among all."""
    kinds = [("SIU", "fraud", "motor", "France", "high", 9, 2), ("SIU", "fraud", "motor", "France", "high", 9, 3), ("CAT", None, None, None, "low", 0, 1), ("CAT", "cat", "marine", "Spain", "critical", 4, 0)]
    schema = "handler_id long, full_name string, team string, skills string, lines string, countries string, max_severity string, capacity int, open_claims int, active boolean"
    claims = spark.createDataFrame([(1, "SIU", "fraud", "low", "motor", "FRANCE"), (2, "CAT", None, "critical", None, None), (3, "CAT", "cat", "low", "marine", "Spain"), (4, "X", "none", None, "motor", None)],
                                   "claim_id long, team string, required_skill string, severity string, line_of_business string, country string")
    monkeypatch.setattr(triage, "KIND_PART", 4)
    rows = {}
    for n in (6, 60):
        staff = spark.createDataFrame([(i, f"N{i * 7 % 5}", *kinds[i % 4], i % 11 != 3) for i in range(4 * n)], schema)
        rows[n] = triage._kinds(triage._staff(staff), 4).count()
        got = triage.handler_scores(claims, staff)
        score, blocked = triage._fit(triage.F.col("open_claims"))
        want = triage._asked(claims).crossJoin(triage._staff(staff)).select(*triage.DEMAND, "handler_id", "full_name", score.alias("score"), blocked.alias("blocked"))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
        assert sorted(map(tuple, triage.assignments(claims, triage.leading_scores(claims, staff)).collect()), key=str) == sorted(map(tuple, triage.assignments(claims, want).collect()), key=str)
    assert rows[6] == rows[60] == 4


def test_texts_of_a_verdict_are_read_once(spark):
    """The texts behind a coverage verdict stand once in its expression: each was read again for every field that uses it."""
    names = ("date_of_loss", "effective_date", "expiry_date", "cause_of_loss", "loss_type", "loss_description", "exclusions", "perils", "estimated_loss_minor", "limit_minor", "loss_location",
             "primary_location", "region", "policy_country", "policy_status", "policy_id", "policy_confirmed")
    kinds = {"date_of_loss": "timestamp_ntz", "effective_date": "date", "expiry_date": "date", "estimated_loss_minor": "long", "limit_minor": "long", "policy_id": "long", "policy_confirmed": "boolean"}
    rows = spark.createDataFrame([], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)).select(assessment.coverage().alias("v"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("cause_of_loss") == 1 and plan.split("\n")[0].count("primary_location") == 1
