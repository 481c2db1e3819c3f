"""Corpus preparation: five stages over ``documents``, each written and read again.

Quality rules drop rejected documents and failing lines; line dedup drops a
host's boilerplate lines; the n-gram Jaccard join keeps the document with the
smallest doc_id of each near-duplicate group; decontamination drops documents
that benchmark items leaked into; mixing gives each document that is left the
words the mix takes of it.

Edge cases: rows are told apart by doc_id and text where doc_ids are null or repeat, so each such text is judged by itself in every stage and
only copies and near copies of it go; null and empty texts fail the quality rules; ties within a group go to the smallest doc_id; very
long texts are read whole; columns other than those of documents are left out; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.llm import decontaminate, line_dedup, mixing, ngram_jaccard, quality_rules
from lossbook.llm.store import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length; null texts stay null."""
    return docs.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast("long")).withColumn("text", F.col(text)).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(docs, carry=("doc_id", "lang", "source", "n_chars"))
    return _with_text(judged.filter("kept"), "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line on over a twentieth of a host's distinct pages, and on three, goes: copies of a page count once.

    A page that would lose all its lines is a copy rather than boilerplate and keeps them for the next stage to judge.
    """
    cleaned = line_dedup.drop_boilerplate(docs.withColumn("whole_text", F.col("text")), max_ratio=0.05, min_pages=3, copies_once=True)
    text = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise(F.col("whole_text"))
    return _with_text(cleaned.withColumn("kept_text", text), "kept_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of rows with an id of their own the smallest doc_id, else the row whose hash of id and text is smallest."""
    text_hash = F.xxhash64(F.lit("near"), "doc_id", "text")
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("doc_id is null or rows > 1").select(F.col("doc_id").alias("of"), F.lit(True).alias("shared"))
    shared = saved(shared, "pipeline-shared-ids")
    if shared.isEmpty():
        gone = ngram_jaccard.jaccard_components(docs).filter("component_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    told = docs.join(shared, F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("node", F.when(F.col("shared"), text_hash).otherwise(F.col("doc_id")))
    told = told.select("node", *COLUMNS)
    groups = ngram_jaccard.jaccard_components(told, key="node")
    gone = groups.filter("component_id <> node").select("node").distinct()
    kept = told.join(gone, "node", "left_anti")
    once = kept.join(shared.select(F.col("of")), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").dropDuplicates(["node"])
    return kept.join(shared.select("of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_anti").unionByName(once).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mix", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the retrieval and component stages; tests hold the pipeline against plain Python instead.
ORACLE_SQL = None
