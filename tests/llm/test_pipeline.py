"""The pipeline against plain Python for its filtering stages."""

from __future__ import annotations

import random

from helpers import jaccard_groups, sentence

import corpus_pipeline


def test_run(spark, tmp_path):
    rng = random.Random(2)
    base = sentence(rng, 120)
    item = sentence(rng, 30) + "\n" + sentence(rng, 10)
    rows = [(i, sentence(rng, 60) + "\nshared footer of the site.", "en", "a", 0) for i in range(30)]
    rows += [(40 + i, base, "en", "b", 0) for i in range(3)] + [(50, sentence(rng, 50) + " " + item.replace("\n", " "), "en", "b", 0)]
    rows += [(60, "too short", "en", "b", 0), (61, None, "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [r for r in rows if r[0] not in (60, 61)]
    groups = jaccard_groups([(d, t, None) for d, t, *_ in kept])
    assert set(got) == {d for d, (_, c) in groups.items() if d == c} - {50}
    assert got[0].size == 60 and got[40].size == 120
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_lines_of_a_large_host(spark):
    """A line on 7% of a host's pages goes; copies of one page don't make its lines boilerplate; a host of four pages loses a line of all four."""
    rng = random.Random(4)
    copy = sentence(rng, 40) + "\n" + sentence(rng, 40)
    rows = [(i, sentence(rng, 30) + ("\nshared footer of the site." if i < 14 else ""), "en", "a", 0) for i in range(200)]
    rows += [(300 + i, copy, "en", "a", 0) for i in range(40)] + [(400 + i, f"{sentence(rng, 30)}\nfooter", "en", "b", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {d: copy if t == copy else t.split("\n")[0] for d, t, *_ in rows}


def test_awkward_rows(spark, tmp_path):
    """Null and repeated doc_ids are told apart by their texts; clashing columns and an empty table do no harm."""
    rng = random.Random(14)
    texts = [sentence(rng, 60) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3] + " more words"), (9, texts[4]), (9, texts[4]), (1, sentence(rng, 30_000)), (2, ""), (3, None)]
    frame = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wide = frame.selectExpr("*", "1 AS node", "2 AS clean_text", "3 AS n_words", "4 AS shared", "5 AS whole_text", "6 AS _drop", "7 AS size")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.size) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) in (
        sorted([(None, 60), (None, 60), (7, 60), (7, 60), (9, 60), (1, 30_000)], key=str), sorted([(None, 60), (None, 60), (7, 60), (8, 62), (9, 60), (1, 30_000)], key=str),
    )
    wide.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
