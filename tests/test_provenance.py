"""Provenance against comparing every stretch of a value with every place of every text."""

from __future__ import annotations

import random
import re

from lossbook.operators import provenance


def test_longest_stretch_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["fire", "unit", "7", "leeds", "the", "ltd"])
    line = lambda n: " ".join(word() for _ in range(n))
    values = [(c, p, line(rng.randrange(0, 5))) for c in range(8) for p in ("a", "b", "c")] + [(1, "null", None), (None, "a", "fire"), (3, "mixed", "Fire, UNIT-7"), (3, "mixed", "Fire, UNIT-7")]
    texts = [(c, s, line(rng.randrange(0, 60))) for c in range(8) for s in range(3)] + [(2, 9, None), (3, 7, "x Fire!  unit 7"), (5, 8, "the " * 3000), (99, 0, "fire")]
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    want, edges = {}, set()
    for c, p, v in values:
        w, best = split(v), None
        for tc, s, t in texts:
            tw = split(t)
            for at in range(len(tw)) if tc == c else []:
                for i in range(len(w)):
                    n = 0
                    while i + n < len(w) and at + n < len(tw) and w[i + n] == tw[at + n]:
                        n += 1
                    if n and (i == 0 or at == 0 or w[i - 1] != tw[at - 1]):
                        best = min(best or (0,), (-n, s, at, i, tw))
                        if n == len(w):
                            edges.add((c, f"document:{c}/{s}", f"field:{c}/{p}"))
        if best:
            n, s, at, _, tw = best
            want[c, p] = (s, at, -n, -n == len(w), " ".join(tw[max(0, at - provenance.AROUND) : at - n + provenance.AROUND]))
    v, t = spark.createDataFrame(values, "case_id long, path string, value string"), spark.createDataFrame(texts, "case_id long, source int, text string")
    got = provenance.field_provenance(v, t).collect()
    assert {(r.case_id, r.path): (r.source, r.place, r.length, r.whole, r.excerpt) for r in got} == want and len(got) == len(want)
    assert {(r.case_id, r.src, r.dst) for r in provenance.evidence_edges(v, t).collect()} == edges
    assert provenance.field_provenance(v.limit(0), t).count() == 0 and provenance.evidence_edges(v, t.limit(0)).count() == 0


def test_texts_leave_no_words_and_large_cases_are_dealt(spark, monkeypatch):
    """Only texts, values and best stretches are shuffled; results don't depend on how a case is dealt or on how many words meet at once."""
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(["a", "a", "b", "c1"]) for _ in range(n))
    v = spark.createDataFrame([(c, p, line(rng.randrange(1, 6))) for c in range(3) for p in ("x", "y")], "case_id long, path string, value string")
    t = spark.createDataFrame([(1 if s % 2 else s % 3, s, line(rng.randrange(0, 30))) for s in range(60)] + [(2, 99, "é, c1! " * 400)], "case_id long, source int, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(provenance.field_provenance(v, t)), key(provenance.evidence_edges(v, t))
    plan = provenance.field_provenance(v, t)._jdf.queryExecution().executedPlan().toString() + provenance.evidence_edges(v, t)._jdf.queryExecution().executedPlan().toString()
    assert "word" not in plan and "diagonal" not in plan and "Window" not in plan
    monkeypatch.setattr(provenance, "TEXTS_PER_TASK", 4)
    assert (key(provenance.field_provenance(v, t)), key(provenance.evidence_edges(v, t))) == want
    met = provenance._met(v, t).toArrow().to_batches()
    found = lambda: sorted(tuple(r.values()) for b in provenance._longest(met) for r in b.to_pylist())
    whole = found()
    monkeypatch.setattr(provenance, "MEETINGS", 20)
    monkeypatch.setattr(provenance, "ROWS", 7)
    assert found() == whole and len(whole) > 60
