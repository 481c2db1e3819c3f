"""Periodic runs against all intervals of small texts, and over awkward inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import sentence, words_of
from pyspark.sql import functions as F

from lossbook.llm import periodic_runs


def all_runs(words, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) from every stretch with a period that can't be extended, smallest period of each interval."""
    found = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(least, exponent * q):
                found.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def altered(key, text):
    """The rule of ``with_periods`` word by word."""
    words = words_of(text)
    h = None if key is None else zlib.crc32(str(key).encode())
    if words and h is not None and h % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def collapsed(words, runs) -> str:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("many", "short"), [(1, 0), (3, 0), (10**9, 0), (3, 16), (1, 64)])
@pytest.mark.parametrize("shape", [(6, 4), (2, 3), (1, 5), (30, 4)])
def test_runs_against_all_intervals(monkeypatch, many, short, shape):
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    monkeypatch.setattr(periodic_runs, "MANY", many)
    least, exponent = shape
    rng = random.Random(many + exponent)
    docs = [[], [1], [1] * 40, [1, 2] * 30 + [1], [1, 2, 1] * 12 + [1, 2] * 12, ([1] * 6 + [2]) * 9]
    docs += [[rng.randrange(k) for _ in range(rng.randrange(90))] for k in (1, 2, 2, 2, 3, 3, 4) for _ in range(12)]
    for _ in range(30):
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        docs.append([rng.randrange(3) for _ in range(rng.randrange(12))] + unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit))] + [rng.randrange(3) for _ in range(rng.randrange(12))])
    offsets = np.cumsum([0, *map(len, docs)])
    start, end, period = periodic_runs.runs_of(np.array([w for d in docs for w in d], np.int32), offsets, least, exponent)
    for i, words in enumerate(docs):
        mine = (start >= offsets[i]) & (start < offsets[i + 1])
        assert [(int(s - offsets[i]), int(e - s), int(q)) for s, e, q in zip(start[mine], end[mine], period[mine], strict=True)] == all_runs(words, least, exponent)


def test_z_function():
    rng = random.Random(2)
    for _ in range(100):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = periodic_runs.z_function(np.array(s))
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s)))


def test_query_by_brute_force(spark):
    rng = random.Random(8)
    units = ["ja nein", "a", "eins zwei drei vier", "É ß 中"]
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(120)]
    texts += [f"{sentence(rng, 9)} {(u + ' ') * rng.randrange(3, 20)}\n{sentence(rng, 5)}" for u in units for _ in range(15)]
    texts += [None, "", " \n\t ", "x", "wort " * 3000, sentence(rng, 20_000) + " so ist es" * 40]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "b " * 30, "k", 1), (5, texts[5], "k", 1), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    found = periodic_runs.collapse_runs(periodic_runs.with_periods(frame))
    got = sorted(map(tuple, periodic_runs.digests(found).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        words = altered(key, text)
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), collapsed(words, runs))]
        want.append((key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest, len(words)))
    assert got == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 60


def test_empty_table_and_carried_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(periodic_runs.collapse_runs(periodic_runs.with_periods(empty))).count() == 0
    rows = spark.createDataFrame([("a", "x y " * 5, 7)], "id string, body string, start int")
    got = periodic_runs.collapse_runs(rows, text="body", carry=("id", "start", "body")).withColumn("n", F.size("runs")).first()
    assert (got.id, got.start, got.body, got.n, got.collapsed) == ("a", 7, "x y " * 5, 1, "x y")
