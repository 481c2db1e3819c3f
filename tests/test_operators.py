"""Operators on small tables with expectations worked out by hand."""

from __future__ import annotations

import datetime
import io
import random
import zipfile

from pyspark.sql import functions as F

from lossbook import thresholds
from lossbook.operators import assessment, matching, merge, queue, triage
from lossbook.sources import documents
from lossbook.streaming.intake import distinct_messages


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a", 0.5, True, 1), (1, 2, "b", 0.5, False, 1)], "case_id long, field_no int, value string, confidence double, human_modified boolean, evidence long")
    new = spark.createDataFrame([(1, 1, "x", 0.9, False, 7), (1, 2, "y", 0.9, False, 7), (2, 1, "z", 0.9, False, 7)], old.schema)
    once = merge.merge_fields(old, new)
    assert {(r.case_id, r.field_no): r.value for r in once.collect()} == {(1, 1): "a", (1, 2): "y", (2, 1): "z"}
    assert sorted(merge.merge_fields(once, new).collect()) == sorted(once.collect())


def test_numbers_have_no_gaps(spark):
    rows = spark.range(500).select("id", F.expr("timestamp_ntz'2001-01-01 00:00:00' + interval '7' hour * cast(id * 37 % 500 as int)").alias("at"))
    got = [r.reference for r in merge.numbered(rows, "FNOL", "at", "id").orderBy("at", "id").collect()]
    assert got == [f"FNOL-2001-{n:06d}" for n in range(1, 501)]


def test_status(spark):
    rows = spark.createDataFrame(
        [("received", ["no_policy_match", "missing_critical_information"], False), ("received", ["high_severity"], False), ("referred", ["no_policy_match"], False), ("received", [], True), ("cancelled", [], True)],
        "s string, codes array<string>, failed boolean",
    )
    got = [r[0] for r in rows.select(assessment.derived_status(F.col("s"), F.col("codes"), F.col("failed"))).collect()]
    assert got == ["incomplete", "ready_for_claim", "referred", "ai_processing_failed", "cancelled"]


def test_classification(spark):
    rows = spark.createDataFrame([("Fire damage in the warehouse, sprinkler failed",), ("nothing to see",), (None,)], "t string")
    got = [tuple(r.c) for r in rows.select(triage.classify_line(F.col("t")).alias("c")).collect()]
    assert got == [("property", 0.7, 3.5), ("unknown", 0.0, 0.0), ("unknown", 0.0, 0.0)]


def test_candidates_equal_brute_force(spark):
    """Numbers and first words within longer ones, broker references, emails, and country, line and date where a notice tells nothing else."""
    day = datetime.date(2001, 5, 5)
    cases = [(i, f"20{i % 7}", f"Name{i % 5} Ltd", None, f"Brk{i % 3} x", None, "france", "motor", day) for i in range(20)]
    cases += [(30, "2026-0041", None, None, None, None, None, None, None), (31, None, "Logistics", None, None, None, None, None, None), (32, None, "of", None, None, None, None, None, None)]
    cases += [(40, None, None, None, None, None, "France ", None, day), (41, None, "", None, None, None, None, "motor", None), (42, None, None, None, None, None, None, None, None), (43, None, None, None, "Alpha", None, None, None, None)]
    cases += [(44, None, None, None, None, " A@B.com", None, None, None), (45, "--", None, None, None, None, "spain", "motor", datetime.date(1990, 1, 1)), (46, None, "50%_", None, None, None, None, None, None)]
    policies = [(j, f"pol-20{j}", f"name{j} limited", None, f"brk{j} y", None, None, "France" if j % 2 else "Spain", "motor" if j % 3 else "marine", datetime.date(2001, 1, 1), datetime.date(2001, 12, 31)) for j in range(8)]
    policies += [(20, "POL-2026-0041", "Northline Logistics Ltd", "Loft Holdings", "b", "ref/alpha/9", "a@b.com", "Spain", "motor", datetime.date(1989, 1, 1), datetime.date(1991, 1, 1))]
    c = spark.createDataFrame([(*x[:8], x[8] and datetime.datetime.combine(x[8], datetime.time())) for x in cases], "case_id long, policy_number string, insured_name string, insured_organisation string, reporter_organisation string, reporter_email string, loss_country string, line_of_business string, date_of_loss timestamp_ntz")
    p = spark.createDataFrame(policies, "policy_id long, policy_number string, insured_name string, insured_organisation string, broker_name string, broker_reference string, insured_email string, country string, line_of_business string, effective_date date, expiry_date date")
    form = lambda x: "".join(ch for ch in (x or "").lower() if ch.isalnum())
    lead = lambda x: next((w for w in (x or "").split() if len(w) > 2), (x or "").strip()).lower()
    within = lambda k, v: bool(k) and k in (v or "").lower()
    want = set()
    for cid, number, insured, org, broker, email, country, line, loss in cases:
        told = [form(number), lead(insured), lead(org), lead(broker), (email or "").strip()]
        for pid, pn, pi, po, pb, pr, pe, pc, pl, first, last in policies:
            if any(told):
                hit = within(form(number), form(pn)) or within(lead(insured), pi) or within(lead(org), po) or within(lead(broker), pb) or within((broker or "").strip().lower(), pr) or (email and (pe or "") == email.strip().lower())
            else:
                hit = (not country or country.strip().lower() == pc.lower()) and (not line or line == pl) and (not loss or first <= loss <= last)
            want |= {(cid, pid)} if hit else set()
    assert {tuple(r) for r in matching.policy_candidates(c, p).collect()} == want
    few = matching.policy_candidates(c, p, thresholds.Thresholds(policy_candidates=2)).collect()
    order = {x[0]: (x[1], x[0]) for x in policies}
    assert {tuple(r) for r in few} == {(k, x) for k in {a for a, _ in want} for x in sorted((y for a, y in want if a == k), key=order.get)[:2]}


def test_duplicate_candidates_equal_brute_force(spark):
    """Every signal alone makes a candidate, the newest are kept, and a first word that all records share is no reason to lose one."""
    rng = random.Random(3)
    start = datetime.datetime(2001, 3, 1)
    rows = []
    for i in range(160):
        loss = None if i % 19 == 0 else start + datetime.timedelta(minutes=rng.randrange(60 * 24 * 40))
        rows.append((i, rng.choice([None, "", f"P-{i % 30}", f"xP-{i % 30}9"]), rng.choice([None, i % 25]), rng.choice([None, "The Mill", f"Acme{i % 40} Ltd", "of"]), rng.choice([None, f"E{i % 20}"]), loss, start + datetime.timedelta(hours=i % 90)))
    rows += [(200, None, None, "Solo", None, start, start), (201, None, None, "Other", None, start + datetime.timedelta(days=3), start), (202, None, None, "Third", None, start + datetime.timedelta(days=3, microseconds=1), start)]
    frame = spark.createDataFrame(rows, "id long, policy_number string, policy_id long, insured_name string, external_reference string, date_of_loss timestamp_ntz, moment timestamp_ntz")
    lead = lambda x: next((w for w in (x or "").split() if len(w) > 2), (x or "").strip()).lower()
    for most in (50, 5):
        want = set()
        for a in rows:
            found = []
            for b in rows:
                near = a[5] and b[5] and abs(a[5] - b[5]) <= datetime.timedelta(days=3)
                number, name = (a[1] or "").strip().lower(), lead(a[3])
                hit = (number and number in (b[1] or "").lower()) or (a[2] is not None and a[2] == b[2]) or (name and name in (b[3] or "").lower()) or (a[4] and a[4] == b[4]) or near
                if hit and a[0] != b[0] and b[6] >= start + datetime.timedelta(hours=-1):
                    found.append(b)
            want |= {(a[0], b[0]) for b in sorted(found, key=lambda b: (-b[6].timestamp(), b[0]))[:most]}
        got = matching.duplicate_candidates(frame, frame, "2001-02-28 23:00:00", F.col("external_reference"), F.col("external_reference"), limits=thresholds.Thresholds(duplicate_candidates=most))
        assert {tuple(r) for r in got.collect()} == want


def test_readers(spark):
    def office(name: str, xml: str) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            archive.writestr(name, xml)
        return data.getvalue()

    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    several = io.BytesIO()
    with zipfile.ZipFile(several, "w") as archive:
        archive.writestr("word/document.xml", f"<w:d {word}><w:p><w:t>Fire &amp; smoke</w:t></w:p></w:d>")
        archive.writestr("word/header1.xml", f"<w:h {word}><w:p><w:t>Northline</w:t></w:p></w:h>")
    rows = [
        ("a.json", "application/json", b'{"a": {"b": [1, "x"]}, "c": null}'), ("b.json", "application/json", b"{oops"), ("c.txt", "text/plain", b"hello\xff"), ("d.png", "image/png", b"\x89PNG"),
        ("e.docx", docx, office("word/document.xml", f"<w:d {word}><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:d>")), ("f.docx", docx, b"not a zip"),
        ("g.docx", docx, several.getvalue()), ("h.csv", "text/csv", b"name,loss,note\nAnn,12,\nBob,,x\n"), ("i.txt", "text/plain", b"  \n"), ("j.txt", "text/plain", None),
    ]
    got = {r.filename: (r.text, r.status, r.reason) for r in documents.read_attachments(spark.createDataFrame(rows, "filename string, content_type string, content binary")).collect()}
    assert got == {
        "a.json": ("a b[0]: 1\na b[1]: x", "extracted", None), "b.json": (None, "failed", "JSONDecodeError"), "c.txt": ("hello\ufffd", "extracted", None),
        "d.png": (None, "unsupported", "no reader for image/png"), "e.docx": ("One\nTwo", "extracted", None), "f.docx": (None, "failed", "BadZipFile"),
        "g.docx": ("Fire & smoke\nNorthline", "extracted", None), "h.csv": ("name: Ann; loss: 12\nname: Bob; note: x", "extracted", None),
        "i.txt": (None, "unsupported", "no text"), "j.txt": (None, "failed", "AttributeError"),
    }


def test_rows_without_a_moment_and_hot_keys(spark):
    """Numbering keeps rows without a moment; of many repeats of one key the first stays."""
    rows = spark.sql("SELECT id, CASE WHEN id < 3 THEN NULL ELSE timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) % 2) END AS at FROM range(10)")
    got = merge.numbered(rows, "FNOL", "at", "id").collect()
    assert len(got) == 10 and sum(r.reference is None for r in got) == 3 and {r.reference for r in got if r.reference} == {f"FNOL-2001-{n:06d}" for n in range(1, 8)}
    hot = spark.range(1000).select(F.when(F.col("id") < 990, "same").alias("k"), (1000 - F.col("id")).alias("n"), F.col("id"))
    assert sorted((r.k, r.n) for r in merge.first_arrivals(hot, "k", ("n",)).collect() if r.k) == [("same", 11)] and merge.first_arrivals(hot, "k", ("n",)).count() == 11


def test_money_labels(spark):
    rows = [(94_000, "GBP"), (120_000, "USD"), (48_200_000_00, "EUR"), (99_999_999, "GBP"), (-150_000, "SGD"), (12_345_678_900, "JPY"), (None, "GBP"), (50, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m long, c string").coalesce(1).select(queue.money(F.col("m"), F.col("c"))).collect()]
    assert got == ["£940", "$1.2k", "€48.2m", "£1,000k", "S$-1.5k", "123.46m", None, "0"]


def test_stream_drops_redelivery(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "2024-01-01 00:00:00"), ("m1", "2024-01-01 00:05:00"), ("m2", "2024-01-01 00:06:00")], "message_id string, t string")
    rows.select("message_id", F.col("t").cast("timestamp").alias("received_at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("message_id string, received_at timestamp").parquet(f"{tmp_path}/in")
    query = distinct_messages(stream).writeStream.format("memory").queryName("intake").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.message_id for r in spark.table("intake").collect()) == ["m1", "m2"]


def test_events_of_any_length(spark):
    """A drought of two years and an open-ended event take losses as short events do."""
    events = spark.sql("SELECT * FROM VALUES (1, DATE'2000-01-01', DATE'2001-12-31'), (2, DATE'2001-06-01', DATE'2001-06-03'), (3, DATE'2001-01-01', DATE'9999-12-31'), (4, NULL, DATE'2001-06-03') AS t(event_id, start_date, end_date)")
    cases = spark.sql("SELECT id AS case_id, timestamp_ntz'1999-12-01 12:00:00' + make_dt_interval(cast(id AS int)) AS date_of_loss FROM range(1000)")
    want = set()
    for i in range(1000):
        day = datetime.date(1999, 12, 1) + datetime.timedelta(i)
        for event, first, last in ((1, datetime.date(1999, 12, 30), datetime.date(2002, 1, 2)), (2, datetime.date(2001, 5, 30), datetime.date(2001, 6, 5)), (3, datetime.date(2000, 12, 30), datetime.date.max)):
            want |= {(i, event)} if first <= day <= last else set()
    got = [(r.case_id, r.event_id) for r in matching.event_window(cases, events).select("case_id", "event_id").collect()]
    assert sorted(got) == sorted(want)
