"""Stored analyses overwritten by kind and read back by path."""

from __future__ import annotations

import datetime
import json

from lossbook.operators import analyses

NEW = "case_id long, kind string, provider string, confidence double, updated_at timestamp_ntz, result string"
DAY = datetime.datetime(2001, 1, 1)


def test_overwritten_and_read_back(spark, tmp_path):
    check = {"key": "in_force", "label": "In force", "state": "pass", "detail": "é"}
    first = [
        (1, "coverage", "rules", 0.5, DAY, json.dumps({"indicator": "likely_covered", "reasoning": "r", "checks": [check, {}, 3, None]})), (2, "coverage", "rules", None, DAY, "{not json"),
        (3, "coverage", None, 0.1, DAY, None), (1, "fraud", "rules", 0.5, DAY, json.dumps({"level": "high", "score": "0.7", "indicators": [{"code": "late", "weight": 1}]})),
        (1, "extraction", "m", 0.5, DAY, json.dumps({"loss": {"date_of_loss": {"value": "3 May"}}})), (2, "extraction", "m", 0.5, DAY, "[1]"), (None, "fraud", "x", 0.5, DAY, "{}"), (1, None, "x", 0.5, DAY, "{}"),
    ]
    stored = analyses.record(None, spark.createDataFrame(first, NEW))
    stored.write.parquet(f"{tmp_path}/analyses")  # a VARIANT column in a table
    stored = spark.read.parquet(f"{tmp_path}/analyses")
    later = [(2, "coverage", "model", 0.9, DAY + datetime.timedelta(days=1), json.dumps({"indicator": None, "checks": "none"})), (1, "coverage", "old", 0.9, DAY - datetime.timedelta(days=1), "{}")]
    now = analyses.record(stored, spark.createDataFrame(later, NEW))
    got = {r.case_id: r for r in analyses.coverage(now).collect()}
    assert (got[1].indicator, got[1].reasoning, got[1].produced_by) == ("likely_covered", "r", "rules")
    assert [tuple(c) for c in got[1].checks] == [("in_force", "In force", "pass", "é"), ("", "", "unknown", "")]
    assert (got[2].indicator, got[2].checks, got[2].produced_by, got[2].confidence) == ("insufficient_information", [], "model", 0.9)
    assert (got[3].indicator, got[3].reasoning, got[3].produced_by) == ("insufficient_information", "", None)
    (risk,) = analyses.fraud(now).collect()
    assert (risk.level, risk.score, [tuple(i) for i in risk.indicators]) == ("high", 0.7, [("late", "", "", 1.0)])
    assert {r.case_id: r.raw for r in analyses.raw_loss_date(now).collect()} == {1: "3 May", 2: None}
    assert analyses.record(now, spark.createDataFrame(later, NEW)).count() == now.count() == 6
    assert analyses.coverage(analyses.record(None, spark.createDataFrame([], NEW))).count() == 0
