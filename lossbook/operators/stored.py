"""Stored tables that merges change in place: only the parts that an incoming batch touches are read and written.

A table is kept in ``parts`` folders by a hash of the case. A batch's parts are found first (at most ``parts`` numbers reach the driver), the stored side reads these folders alone, the
merge runs on them, and they are written over; other folders aren't looked at. The merged rows are written beside the table first, so a job that fails while it writes over the
folders can be run again: every merge of ``operators.merge`` gives the same rows when its batch comes twice.

Edge cases: a table that isn't there yet is empty; an empty batch changes nothing; null case_ids share a part; a part that a merge empties loses its folder's rows; a writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lossbook.store import saved

PARTS = 256


def part_of(case_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(parts)).cast("int")


def read_table(spark: SparkSession, path: str, schema: StructType, numbers: list[int] | None = None) -> DataFrame:
    """The table, or some parts of it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields]).add("part", IntegerType())).parquet(path)
    return (rows if numbers is None else rows.filter(F.col("part").isin(numbers))).drop("part")


def merge_into(path: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Merge a batch into the table at ``path`` and return the parts it touched. batch has the table's columns, case_id among them."""
    spark = batch.sparkSession
    batch = saved(batch, "merge-batch")
    touched = sorted(r[0] for r in batch.select(part_of(F.col("case_id"), parts)).distinct().collect())
    if not touched:
        return []
    merged = merge(read_table(spark, path, batch.schema, touched), batch).select(*batch.columns).withColumn("part", part_of(F.col("case_id"), parts))
    merged = saved(merged, "merged")
    left = {r[0] for r in merged.select("part").distinct().collect()}
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for number in set(touched) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
