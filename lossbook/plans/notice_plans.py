"""Queries of reading whole notices, and their oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lossbook.operators import notice
from lossbook.sources.adapters import load, oracle_with
from lossbook.vocab import (
    COUNT_AFTER_PATTERN, COUNT_BEFORE_PATTERN, EMAIL_PATTERN, NEGATION_PATTERN, NEXT_LABEL_PATTERN, NOTHING_VALUES, NOTICE_COUNTS, NOTICE_FLAGS, NOTICE_LABELS, NOTICE_PATTERNS,
    PHONE_PATTERN, SILENT_VALUES,
)

_N = "chr(10)"
#: Notices as they come: a broker's email, a portal's export, prose, a short call note, an empty one.
BODY = f"""CASE CAST(case_id % 6 AS INT)
  WHEN 0 THEN 'Subject: new loss - ' || insured_name || {_N} || {_N} || 'Policy number: ' || coalesce(policy_number, 'TBC') || {_N} || 'Insured: ' || insured_name || {_N}
    || 'Reported by: ' || coalesce(reporter_name, 'unknown') || {_N} || 'Broker: ' || coalesce(reporter_organisation, 'n/a') || {_N} || 'Contact email: ' || coalesce(reporter_email, '-') || {_N} || {_N}
    || 'Date of loss: ' || CAST(CAST(received_at AS DATE) AS STRING) || {_N} || 'Location: ' || coalesce(loss_location, 'unknown') || {_N} || 'Cause: ' || coalesce(cause_of_loss, 'None') || {_N}
    || 'Description: ' || coalesce(loss_description, 'nothing yet') || {_N} || '  and the rest is being looked at.  ' || {_N} || 'Nobody was there.' || {_N}
    || 'Injuries: ' || CASE WHEN injuries = 0 THEN 'none' ELSE coalesce(CAST(injuries AS STRING), 'n/a') END || {_N} || 'Estimated loss: GBP ' || CAST(case_id % 900 AS STRING) || ',000' || {_N}
    || 'Enclosed: photographs' || {_N} || coalesce(source_body, '')
  WHEN 1 THEN '> Policy no - ' || coalesce(policy_number, '-') || {_N} || '* ASSURED: ' || upper(insured_name) || '   ' || {_N} || '• Loss date : 0' || CAST(1 + case_id % 9 AS STRING) || '/03/2001' || {_N}
    || 'Police ref: ' || coalesce(police_reference, 'tbc') || {_N} || 'Country: ' || coalesce(loss_country, '') || {_N} || 'Summary: ' || coalesce(loss_description, 'see below') || {_N} || {_N}
    || 'Attended by: ' || coalesce(authorities_involved, 'nobody') || {_N} || 'Phone: +44 20 7946 0' || CAST(100 + case_id % 800 AS STRING) || {_N} || 'Role: clerk'
  WHEN 2 THEN 'Dear team, we write about our client''s premises at ' || coalesce(loss_location, 'a site we cannot name') || ' under POL-2001-' || CAST(1000 + case_id % 9000 AS STRING)
    || ' where a loss came to light on ' || CAST(1 + case_id % 28 AS STRING) || ' March 2001.' || {_N} || {_N}
    || 'The cost is put at £' || CAST(case_id % 90 AS STRING) || '.5k for now and ' || CASE CAST(case_id % 4 AS INT) WHEN 0 THEN 'there were no injuries at all' WHEN 1 THEN CAST(case_id % 7 AS STRING) || ' people were injured'
    WHEN 2 THEN 'one driver died' ELSE 'casualties: 12 so far' END || ', while trade goes on. ' || coalesce(loss_description, '') || '. The landlord''s solicitor has written and a spill is feared.' || {_N} || {_N} || 'Mail me at Desk'
    || CAST(case_id % 50 AS STRING) || '@broker.example.com or call (020) 7946-0' || CAST(100 + case_id % 800 AS STRING) || '.'
  WHEN 3 THEN 'Caller says: ' || coalesce(loss_description, 'no details') || {_N} || 'Structural? roof collapse, production stopped. Fatalities: none' || {_N} || 'Reserve: unknown' || {_N} || 'Reserve: USD 4m'
  WHEN 4 THEN coalesce(loss_description, '') || {_N} || coalesce(source_body, '')
  END"""
SENDER = "CASE WHEN case_id % 4 < 3 THEN 'intake' || CAST(case_id % 9 AS STRING) || '@mail.example.com' END"


def _readings(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = notice.FIELDS) -> DataFrame:
    rows = load(spark, sf_dir, "cases", dealt=True).selectExpr("case_id", f"{BODY} AS body", f"{SENDER} AS sender")
    return notice.read_notices(rows, "case_id", "body", "sender", fields)


def extract_notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each notice tells; fields that it doesn't tell are left out."""
    return _readings(spark, sf_dir).filter("confidence > 0")


def notice_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice.overall_confidence(_readings(spark, sf_dir), "case_id")


def extract_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice.stated_parties(_readings(spark, sf_dir, notice.PARTY_FIELDS), "case_id")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(words: tuple[str, ...]) -> str:
    return ", ".join(map(_q, words))


def _strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _reading(value: str, confidence: float, evidence: str) -> str:
    """A reading as a struct; one that says nothing keeps its confidence."""
    return (
        f"{{'v': CASE WHEN lower({_strip(value)}) NOT IN ({_values(NOTHING_VALUES)}) THEN left({_strip(value)}, 2000) END, 'c': {confidence}::DOUBLE, 'e': nullif(left({_strip(evidence)}, 600), '')}}"
    )


def _around(needle: str) -> str:
    at = f"instr(b, {needle})"
    return f"CASE WHEN {at} > 0 THEN substr(b, greatest({at} - 80, 1), {at} + length({needle}) + 80 - greatest({at} - 80, 1)) ELSE {needle} END"


_EMPTY = "{'v': NULL::VARCHAR, 'c': 0::DOUBLE, 'e': NULL::VARCHAR}"


def _labelled(field: str) -> str:
    """By one pattern over the whole text for each field."""
    pattern = _q(rf"(?im)^[ \t>*•-]*(?:{'|'.join(map(re.escape, NOTICE_LABELS[field]))})[ \t]*[:–-][ \t]*(.+?)[ \t]*$").replace(r"\ ", " ")
    value, line = f"{_strip(f'regexp_extract(b, {pattern}, 1)')}", f"regexp_extract(b, {pattern}, 0)"
    if field == "loss_description":
        after = f"string_split(substr(b, instr(b, {line}) + length({line})), chr(10))[2:]"
        stop = f"list_position([{_strip('y')} = '' OR regexp_matches(y, {_q(NEXT_LABEL_PATTERN.replace(chr(92) + '-', '-'))}) FOR y IN {after}], true)"
        more = f"[{_strip('y')} FOR y IN {after}[:coalesce({stop} - 1, 1000000)]]"
        return f"CASE WHEN lower({value}) NOT IN ({_values(SILENT_VALUES)}) THEN {_reading(f'array_to_string([{value}] || {more}, chr(32))', 0.9, line)} END"
    return f"CASE WHEN lower({value}) NOT IN ({_values(SILENT_VALUES)}) THEN {_reading(value, 0.9, line)} END"


def _counted(field: str) -> str:
    tests = []
    for stem in NOTICE_COUNTS[field]:
        at = f"instr(lower(b), '{stem}')"
        before, after = f"substr(lower(b), greatest({at} - 30, 1), {at} - greatest({at} - 30, 1))", f"substr(lower(b), {at} + {len(stem)}, 24)"
        none = " OR ".join(f"regexp_matches({x}, {_q(NEGATION_PATTERN)})" for x in (before, after))
        number = f"coalesce(nullif(regexp_extract({before}, {_q(COUNT_BEFORE_PATTERN)}, 1), ''), nullif(regexp_extract({after}, {_q(COUNT_AFTER_PATTERN)}, 1), ''), '1')"
        tests.append(f"WHEN {at} > 0 THEN {_reading(f'CASE WHEN {none} THEN chr(48) ELSE {number} END', 0.45, _around(_q(stem)))}")
    return f"CASE {' '.join(tests)} END"


def _flagged(field: str) -> str:
    tests = " ".join(f"WHEN contains(lower(b), {_q(p)}) THEN {_reading(_q('yes'), 0.45, _around(_q(p)))}" for p in NOTICE_FLAGS[field])
    return f"CASE {tests} ELSE {{'v': 'no', 'c': 0.3::DOUBLE, 'e': NULL::VARCHAR}} END"


def _first(*readings: str) -> str:
    return f"coalesce({', '.join(f'CASE WHEN ({r}).v IS NOT NULL THEN {r} END' for r in readings)}, {_EMPTY})"


def _field(field: str) -> str:
    if field in NOTICE_FLAGS:
        return _flagged(field)
    told = _labelled(field)
    if field in NOTICE_PATTERNS:
        found = f"regexp_extract(b, {_q('(?i)' + NOTICE_PATTERNS[field])}, 0)"
        return _first(told, f"CASE WHEN {found} <> '' THEN {_reading(found, 0.45, _around(found))} END")
    if field in NOTICE_COUNTS:
        return _first(told, _counted(field))
    if field == "loss_description":
        parts = r"[p FOR p IN regexp_split_to_array(b, '\n\s*\n') IF length(" + _strip("p") + ") > 80 AND NOT contains(left(p, 24), ':')]"
        best = f"list_sort([{{'n': -length({_strip('p')}), 'i': i, 'p': {_strip('p')}}} FOR p, i IN {parts}])[1].p"
        return _first(told, f"CASE WHEN len({parts}) > 0 THEN {_reading(f'left({best}, 2000)', 0.35, f'left({best}, 200)')} END")
    if field == "reporter_email":
        mail = f"lower(regexp_extract(b, {_q(EMAIL_PATTERN)}, 0))"
        return _first(told, f"CASE WHEN {mail} <> '' THEN {_reading(mail, 0.45, 'NULL')} END", f"CASE WHEN sender IS NOT NULL THEN {_reading('sender', 0.45, _q('message envelope'))} END")
    if field == "reporter_phone":
        digits = f"regexp_replace(regexp_extract(b, {_q(PHONE_PATTERN)}, 0), '[^0-9+]', '', 'g')"
        return _first(told, f"CASE WHEN length(ltrim({digits}, '+')) BETWEEN 7 AND 15 THEN {_reading(digits, 0.45, 'NULL')} END")
    return f"coalesce({told}, {_EMPTY})"


_READ = oracle_with("cases") + f""",
t AS (SELECT case_id, coalesce({BODY}, '') AS b, {SENDER} AS sender FROM cases),
w AS MATERIALIZED (SELECT case_id, {", ".join(f"{_field(f)} AS {f}" for f in notice.FIELDS)} FROM t),
r AS (SELECT case_id, x.f AS field, x.r.v AS value, x.r.c AS confidence, x.r.e AS evidence FROM (SELECT case_id, unnest([{", ".join(f"{{'f': '{f}', 'r': {f}}}" for f in notice.FIELDS)}]) AS x FROM w))
"""
ORACLES = {
    "extract_notice_fields": _READ + "SELECT * FROM r WHERE confidence > 0",
    "notice_confidence": _READ + "SELECT case_id, round(count(value) / count(*)::DOUBLE, 2) AS overall_confidence FROM r GROUP BY case_id",
    "extract_parties": _READ + """SELECT case_id, 'insured' AS role, insured_name.v AS name, insured_organisation.v AS organisation, NULL::VARCHAR AS email, NULL::VARCHAR AS phone, insured_name.c AS confidence
FROM w WHERE insured_name.v IS NOT NULL UNION ALL
SELECT case_id, CASE WHEN reporter_organisation.v IS NULL THEN 'other' ELSE 'broker' END, reporter_name.v, reporter_organisation.v, reporter_email.v, reporter_phone.v, reporter_name.c
FROM w WHERE reporter_name.v IS NOT NULL""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
