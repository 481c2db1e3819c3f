"""Whole notices read into fields, with expectations worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lossbook.functions.parsing import parse_count
from lossbook.operators import notice

EMAIL = """Subject: new claim - Harbour Mills - fire in the store

Policy number: POL-2026-0077
 > Insured: Harbour Mills Limited
Reported by: Ann Example
* Contact email: ann@broker.example.com
Broker - Example & Sons

Date of loss: 03/08/2026
Location: Unit 9, Dock Road
Cause: fire
Description: A fire broke out in bay 2 of the store.
  The sprinklers held it but the roof panels have failed.
Injuries: none
Estimated loss: GBP 64,000
Deaths:\t-
Site: somewhere else
"""
PROSE = """Hello,

we have to tell you that on 4 March 2001 water came through the ceiling of the shop, under policy MC-99-ABC123, and the stock is ruined.

We think it will cost £12.5k. There were no casualties among the staff of the shop itself, but 2 died later. Call +44 20 7946 0123. A court case may follow."""


@pytest.fixture(scope="module")
def read(spark):
    rows = [(1, EMAIL, None), (2, PROSE, "who@sent.example.com"), (3, None, None), (4, "", None), (5, "TEL : 020 7946 0999\r\nPolicy: n/a\nPolicy no: X1\nThere was an injury 3", None), (1, EMAIL, None), (6, "x " * 60_000 + "\nCountry: Spain", None)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "case_id long, t string, sender string, field string, value int")
    out = {}
    for r in notice.read_notices(frame, "case_id", "t", "sender").collect():
        out.setdefault(r.case_id, {}).setdefault(r.field, []).append((r.value, r.confidence, r.evidence))
    return out


def test_labels(read):
    one = {k: v[0] for k, v in read[1].items()}
    assert len(read[1]["country" if "country" in read[1] else "loss_country"]) == 2  # a repeated row is read twice
    assert one["policy_number"] == ("POL-2026-0077", 0.9, "Policy number: POL-2026-0077")
    assert one["insured_name"] == ("Harbour Mills Limited", 0.9, "> Insured: Harbour Mills Limited")
    assert one["reporter_email"][:2] == ("ann@broker.example.com", 0.9) and one["reporter_organisation"][0] == "Example & Sons"
    assert one["date_of_loss"][0] == "03/08/2026" and one["estimated_loss_amount"] == ("GBP 64,000", 0.9, "Estimated loss: GBP 64,000")
    assert one["loss_description"][0] == "A fire broke out in bay 2 of the store. The sprinklers held it but the roof panels have failed."
    assert one["loss_location"][0] == "Unit 9, Dock Road"  # the first line with one of the labels
    assert one["police_reference"] == (None, 0.0, None) and one["fatalities"] == ("000", 0.45, "death")  # the digits before the word
    assert one["structural_damage"] == ("no", 0.3, None)


def test_none_injured_is_zero(spark, read):
    value, sure, _ = read[1]["injuries"][0]
    assert (value, sure) == ("0", 0.45)
    assert spark.range(1).select(parse_count(F.lit(value))).first()[0] == 0


def test_prose(read):
    two = {k: v[0] for k, v in read[2].items()}
    assert two["policy_number"][:2] == ("policy MC-99-ABC123"[7:], 0.45) and two["date_of_loss"][0] == "4 March 2001" and two["estimated_loss_amount"][0] == "£12.5k"
    assert two["injuries"][0] == "0" and two["fatalities"][:2] == ("2", 0.45)
    assert two["reporter_email"] == ("who@sent.example.com", 0.45, "message envelope") and two["reporter_phone"][0] == "+442079460123"
    assert two["loss_description"][1] == 0.35 and two["loss_description"][0].startswith("We think it will cost")
    assert two["potential_litigation"][0] == "yes" and "court case" in two["potential_litigation"][2]


def test_awkward_notices(read):
    for k in (3, 4):
        assert {f for f, v in read[k].items() if v[0][1] > 0} == set(notice.NOTICE_FLAGS)
        assert len(read[k]) == len(notice.FIELDS)
    five = {k: v[0] for k, v in read[5].items()}
    assert five["reporter_phone"] == ("020 7946 0999", 0.9, "TEL : 020 7946 0999")
    assert five["policy_number"][0] is None and five["injuries"][0] == "0"  # the "no" of the line before is near
    assert read[6]["loss_country"][0][0] == "Spain"


def test_parties_and_share(spark):
    frame = spark.createDataFrame([(1, EMAIL), (2, PROSE), (3, "Contact: Bo\nTel: 0123456789")], "case_id long, t string")
    rows = notice.read_notices(frame, "case_id", "t")
    got = sorted(tuple(r) for r in notice.stated_parties(rows, "case_id").collect())
    assert got == [  # by the rule for telephones, the policy number's digits are one
        (1, "broker", "Ann Example", "Example & Sons", "ann@broker.example.com", "20260077", 0.9), (1, "insured", "Harbour Mills Limited", None, None, None, 0.9), (3, "other", "Bo", None, None, "0123456789", 0.9),
    ]
    share = {r.case_id: r.overall_confidence for r in notice.overall_confidence(rows, "case_id").collect()}
    assert share[3] == round(6 / len(notice.FIELDS), 2)


def test_only_what_is_asked_for_is_read(spark):
    """Parties ask for six fields: their rows are those of a whole reading, and no other field's patterns, flags or paragraphs are worked out."""
    rows = [(1, EMAIL, None), (2, PROSE, "who@sent.example.com"), (3, None, "x@y.example.com"), (4, "Policy type: a\nPolicy: b\nInsured - c\nInsured name: d\nEmail - \nno label", None), (5, "- : -\ncontact - email: z@z.example.com", None)]
    frame = spark.createDataFrame(rows, "case_id long, t string, sender string")
    few, whole = notice.read_notices(frame, "case_id", "t", "sender", notice.PARTY_FIELDS), notice.read_notices(frame, "case_id", "t", "sender")
    want = whole.filter(F.col("field").isin(*notice.PARTY_FIELDS))
    assert few.count() == want.count() == 30 and few.exceptAll(want).isEmpty()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "policyholder" in plan and "date of loss" not in plan and "date of loss" in whole._jdf.queryExecution().optimizedPlan().toString()
