"""The edit log against applying edits one after the other, in any order of arrival."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lossbook.operators import edits

EDIT = "change_id long, case_id long, path string, raw string, moment timestamp_ntz, actor string, reason string"
BASE = datetime.datetime(2001, 1, 1)
TEXTS = {
    "loss.injuries": [("none", "0"), ("2 people", "2"), ("2", "2"), ("many", None), (" ", "")], "loss.loss_country": [(" Spain ", "Spain"), ("Spain", "Spain"), ("Peru", "Peru"), (None, "")],
    "loss.structural_damage": [("yes", "true"), ("No", "false"), ("", None), ("maybe", None)], "financial.estimated_loss": [("£2k", "200000"), ("GBP 2,000", "200000"), ("lots", None), ("", "")],
    "loss.date_of_loss": [("4 March 2000", "2000-03-04T00:00:00"), ("2000-03-04", "2000-03-04T00:00:00"), ("soon", None)], "policy.limit": [("9", None)],
}


def book(rng):
    log, n = [], 0
    for case in range(6):
        for _ in range(60):
            path = rng.choice(list(TEXTS))
            raw, value = rng.choice(TEXTS[path])
            log.append(((n, case, path, raw, BASE + datetime.timedelta(minutes=rng.randrange(4000)), f"a{n % 3}", rng.choice((None, "why"))), value))
            n += 1
    log += [((n, 1, "loss.loss_country", "Chile", BASE, "x", None), "Chile"), ((n + 1, None, "loss.loss_country", "Chile", BASE, "x", None), None), ((n + 2, 1, "loss.loss_country", "Chile", None, "x", None), None)]
    initial = [(c, p, {"loss.injuries": "1", "loss.loss_country": "Spain", "financial.estimated_loss": "200000", "loss.structural_damage": "false"}[p]) for c in range(5) for p in ("loss.injuries", "loss.loss_country", "financial.estimated_loss", "loss.structural_damage") if (c + len(p)) % 3]
    converted = [(2, BASE + datetime.timedelta(minutes=2000)), (2, BASE + datetime.timedelta(minutes=3000)), (9, BASE)]
    return log, initial, converted


def applied(log, initial, converted, until=None):
    """(state, human fields, audit rows, refused) by walking over the log in order."""
    state, audit, refused, human = {(c, p): v for c, p, v in initial}, [], {}, set()
    shown = dict(state)
    closed = {2: min(t for c, t in converted if c == 2)}
    for (n, case, path, raw, at, actor, reason), value in sorted(log, key=lambda x: (x[0][4] or BASE, x[0][0])):
        if case is None or at is None:
            refused[n] = "incomplete"
        elif path == "policy.limit":
            refused[n] = "not_editable"
        elif case in closed and at >= closed[case]:
            refused[n] = "converted"
        elif value is None:
            refused[n] = "not_readable"
        elif until is None or at <= until:
            key, new = (case, path), value or None
            told = (raw.strip() if path == "financial.estimated_loss" else new) if new else None
            if state.get(key) != new:
                audit.append((n, case, path, shown.get(key), told))
            state[key], shown[key] = new, told
            human.add(key)
    return state, human, audit, refused


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_in_any_order(spark, seed):
    rng = random.Random(seed)
    log, initial, converted = book(rng)
    rows = [r for r, _ in log] + [r for r, _ in log[::7]]  # some are delivered twice
    rng.shuffle(rows)
    start = spark.createDataFrame(initial, "case_id long, path string, value string")
    read = edits.read_edits(spark.createDataFrame(rows, EDIT).repartition(3), spark.createDataFrame(converted, "case_id long, converted_at timestamp_ntz"))
    _, _, audit, refused = applied(log, initial, converted)
    assert {r.change_id: r.refused for r in read.filter("refused is not null").collect()} == refused
    got = edits.audit_diffs(start, read).collect()
    assert sorted((r.change_id, r.case_id, r.path, r.before, r.after) for r in got) == sorted(audit)
    for minutes in (-1, 1500, 10_000):
        at = BASE + datetime.timedelta(minutes=minutes)
        state, human, _, _ = applied(log, initial, converted, at)
        found = edits.state_as_of(start, read, F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")).collect()
        assert {(r.case_id, r.path): r.value for r in found} == state
        assert {(r.case_id, r.path) for r in found if r.human_modified} == human
        before = {(c, p): v for c, p, v in initial}
        assert all(r.original_value == (before.get((r.case_id, r.path)) if r.human_modified else None) for r in found)


def test_empty_log(spark):
    start = spark.createDataFrame([(1, "loss.injuries", "1")], "case_id long, path string, value string")
    read = edits.read_edits(spark.createDataFrame([], EDIT), spark.createDataFrame([], "case_id long, converted_at timestamp_ntz"))
    assert edits.audit_diffs(start, read).count() == 0
    assert [tuple(r) for r in edits.state_as_of(start, read, F.lit("2001-01-01").cast("timestamp_ntz")).collect()] == [(1, "loss.injuries", "1", False, None)]
