"""Deliveries by two keys against taking messages one by one, in batches and as a stream that restarts; budgets by walking over attachments."""

from __future__ import annotations

import datetime
import random

import pytest

from lossbook.operators import intake

MESSAGE = "row_id long, moment timestamp_ntz, idempotency_key string, message_id string"
BASE = datetime.datetime(2001, 1, 1)


def one_by_one(rows, known=()):
    by_key, by_id, out = {}, {}, {}
    for r, _, k, m in sorted(known, key=lambda x: (x[1], x[0])):
        by_key.setdefault(k, r), by_id.setdefault(m, r)
    for r, _, k, m in sorted(rows, key=lambda x: (x[1], x[0])):
        found = by_key.get(k) if k is not None and k in by_key else by_id.get(m) if m is not None else None
        out[r] = (found is None, found)
        if found is None:
            by_key.setdefault(k, r), by_id.setdefault(m, r)
    return out


def messages(rng, n, keys, start=0):
    pick = lambda letter: None if rng.random() < 0.1 else f"{letter}{rng.randrange(keys)}"
    return [(start + i, BASE + datetime.timedelta(minutes=start + rng.randrange(n)), pick("k"), pick("m")) for i in range(n)]


@pytest.mark.parametrize("keys", [4, 60])
def test_two_keys_by_brute_force(spark, keys):
    rng = random.Random(keys)
    known, rows = messages(rng, 8, keys), messages(rng, 150, keys, 500)
    rows += [(2000 + i, BASE + datetime.timedelta(days=9), "hot", None) for i in range(80)]
    known = [x for x in known if one_by_one(known)[x[0]][0]]
    make = lambda x: spark.createDataFrame(x, MESSAGE)
    assert {r.row_id: (r.created, r.existing) for r in intake.first_deliveries(make(rows).repartition(3)).collect()} == one_by_one(rows)
    assert {r.row_id: (r.created, r.existing) for r in intake.first_deliveries(make(rows), make(known)).collect()} == one_by_one(rows, known)
    assert intake.first_deliveries(make([])).count() == 0


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(messages(rng, 90, 25), key=lambda x: (x[1], x[0]))
    source, table = f"{tmp_path}/in", f"{tmp_path}/cases"

    def run():
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(intake.take_batch(table)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(300)

    for k in range(2):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], MESSAGE).coalesce(1).write.mode("append").parquet(source)
        run()
    # a batch that ran and wrote, but whose commit was lost, runs again
    (last,) = sorted((tmp_path / "state" / "commits").glob("1"))
    last.unlink()
    for crc in (tmp_path / "state" / "commits").glob(".1.crc"):
        crc.unlink()
    spark.createDataFrame(rows[60:], MESSAGE).coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted(r.row_id for r in spark.read.parquet(table).collect())
    assert got == sorted(r for r, (created, _) in one_by_one(rows).items() if created)


def test_what_is_remembered_is_bounded(spark, tmp_path):
    table = f"{tmp_path}/cases"
    take = intake.take_batch(table, keep="1 days")
    for number, day in enumerate((0, 0, 5)):
        take(spark.createDataFrame([(number, BASE + datetime.timedelta(days=day), "k", None)], MESSAGE), number)
    assert sorted(r.row_id for r in spark.read.parquet(table).collect()) == [0, 2]


def test_budgets(spark):
    rng = random.Random(2)
    cases = [(1, " notice \n"), (2, None), (3, "x" * 5000), (4, "alone"), (5, "many")]
    docs = [(c, n, "ab"[n % 2] * rng.choice((10, 1500, 2500, 9000))) for c in (1, 2, 3) for n in (3, 1, 2, 7)] + [(2, 9, None), (99, 1, "nobody's")] + [(5, n, "y" * 300) for n in range(60)]
    make = spark.createDataFrame
    for budget in (1000, 6000, 40_000):
        got = {r.case_id: (r.corpus, r.n_attachments) for r in intake.budgeted(make(cases, "case_id long, notice string"), make(docs, "case_id long, nth int, text string"), budget).collect()}
        for case, notice in cases:
            out = (notice or "").strip()
            left, n = max(0, budget - len(out)), 0
            mine = [t or "" for _, _, t in sorted((d for d in docs if d[0] == case), key=lambda d: d[1])][:40]
            for text in mine:
                if left <= 0:
                    break
                share = min(len(text), max(2000, left // len(mine)))
                n += 1
                out += f"\n\n--- ATTACHMENT {n} ---\n{text[:share]}"
                left -= share
            assert got[case] == (out, n)
