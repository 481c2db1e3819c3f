"""Merges into stored tables against the same merges of whole tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lossbook.operators import merge, stored

FIELDS = "case_id long, field_no int, value string, confidence double, human_modified boolean, evidence long"
MATCHES = "case_id long, policy_id long, score double, selected boolean"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fields_by_parts(spark, tmp_path):
    rng = random.Random(6)
    table = f"{tmp_path}/fields"
    make = lambda cases, tag: spark.createDataFrame([(c, n, f"{tag}{c}{n}", 0.5, rng.random() < 0.3, 1) for c in cases for n in range(3)], FIELDS)
    whole = spark.createDataFrame([], FIELDS)
    for cases, tag in ((range(400), "a"), ([3, 7, 900], "b"), ([3], "c"), ([3], "c"), ([], "d")):
        batch = make(cases, tag).cache()
        want = rows_of(merge.merge_fields(whole, batch))
        touched = stored.merge_into(table, batch, merge.merge_fields, parts=64)
        assert len(touched) <= max(len(cases), 1) and rows_of(stored.read_table(spark, table, batch.schema)) == want
        whole = spark.createDataFrame(want, FIELDS)
    read = stored.read_table(spark, table, whole.schema, stored.merge_into(table, make([5], "e"), merge.merge_fields, parts=64))
    assert {f.split("part=")[1].split("/")[0] for f in read.inputFiles()} >= {str(spark.range(1).select(stored.part_of(F.lit(5).cast("long"), 64)).first()[0])}
    assert read.select("case_id").distinct().count() < 30  # the other parts aren't read


def test_parts_that_a_merge_empties(spark, tmp_path):
    table = f"{tmp_path}/matches"
    first = spark.createDataFrame([(1, 10, 0.9, False), (2, 20, 0.9, True)], MATCHES)
    stored.merge_into(table, first, merge.merge_policy_matches)
    drop = lambda old, new: old.join(new.select("case_id"), "case_id", "left_anti").select(*old.columns)
    stored.merge_into(table, first.filter("case_id = 1"), drop)
    assert [r.case_id for r in stored.read_table(spark, table, first.schema).collect()] == [2]
    assert stored.read_table(spark, f"{tmp_path}/none", first.schema).count() == 0
