"""The operators as queries over the tables of one folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.llm import centroids, decontaminate, fixity, html_blocks, line_dedup, mixing, ngram_jaccard, periodic_runs, quality_classifier, quality_rules, substring_dedup, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.clean_lines(_table(spark, sf_dir, "documents"), with_text=False)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", "n_failed_lines")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica in which some records were altered or lost."""
    pages = _table(spark, sf_dir, "pages")
    replica = pages.filter(F.col("page_id") % 101 != 7).withColumn(
        "html", F.when(F.col("page_id") % 37 == 5, F.concat(F.lit("?"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    )
    return fixity.audit(fixity.warc_records(pages), fixity.warc_records(replica))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_text(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, found).select("vec_id", F.col("cluster").cast("int"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse_runs(periodic_runs.with_periods(_table(spark, sf_dir, "documents"))))


#: (host, path, verdict) of the query's rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op6_warc_fixity": fixity.ORACLE_SQL,
        "op10_source_mix": mixing.ORACLE_SQL
        + """
SELECT doc_id, source, size, source_size, target, (whole + (upto - size / 2.0::DOUBLE <= extra AND extra > 0)::INT)::BIGINT AS epochs,
       ((whole + (upto - size / 2.0::DOUBLE <= extra AND extra > 0)::INT) * size)::BIGINT AS taken
FROM r
""",
        "op11_centroids": centroids.oracle_sql(),
        "op13_url_rules": url_rules.ORACLE_SQL,
    }
