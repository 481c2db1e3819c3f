"""Pure merges: stored rows and incoming rows in, the new table out. One full outer join on the natural key each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = old.select(*keys, F.lit(True).alias("in_old"), *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys])
    right = new.select(*keys, F.lit(True).alias("in_new"), *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys])
    return left.join(right, list(keys), "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_old", "in_new")})


def merge_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, field_no, value, confidence, human_modified, evidence: a person's value wins, evidence is refreshed."""
    human = F.col("in_old") & F.coalesce("old_human_modified", F.lit(False))
    take = F.col("in_new") & ~human
    rows = _joined(old, new, ("case_id", "field_no"))
    pick = lambda c: F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
    return rows.select("case_id", "field_no", pick("value"), pick("confidence"), human.alias("human_modified"), F.when(F.col("in_new"), F.coalesce("new_evidence", "old_evidence")).otherwise(F.col("old_evidence")).alias("evidence"))


def merge_parties(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, role, name, organisation, email: keyed by role and lower-case name, new values over old ones where there are any."""
    key = lambda df: df.withColumn("name_key", F.lower("name"))
    rows = _joined(key(old), key(new), ("case_id", "role", "name_key"))
    return rows.select("case_id", "role", F.coalesce("old_name", "new_name").alias("name"), *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in ("organisation", "email")])


def merge_policy_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, policy_id, score, selected: the incoming list, plus a stored candidate that was selected."""
    rows = _joined(old, new, ("case_id", "policy_id")).withColumn("selected", F.coalesce("old_selected", F.lit(False)))
    return rows.filter(F.col("in_new") | F.col("selected")).select("case_id", "policy_id", F.coalesce("new_score", "old_score").alias("score"), "selected")


def merge_duplicates(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, other_id, score, resolution: decisions stay, unresolved candidates that weren't found again go."""
    rows = _joined(old, new, ("case_id", "other_id")).withColumn("resolution", F.coalesce("old_resolution", F.lit("unresolved")))
    return rows.filter(F.col("in_new") | (F.col("resolution") != "unresolved")).select("case_id", "other_id", F.coalesce("new_score", "old_score").alias("score"), "resolution")


def merge_exceptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, code, status, severity: raised again stays as decided, open ones not raised again go, resolved ones stay."""
    rows = _joined(old, new, ("case_id", "code"))
    keep = F.col("in_new") | (F.col("old_status") != "open")
    return rows.filter(keep).select("case_id", "code", F.coalesce("old_status", F.lit("open")).alias("status"), F.coalesce("new_severity", "old_severity").alias("severity"))


def first_arrivals(messages: DataFrame, key: str, order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Idempotent intake: the first message of each key that isn't known yet; messages without a key all pass. One partial aggregate, so a key with many repeats never meets in one task."""
    whole = F.struct(*messages.columns)
    keyed = messages.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.struct(*[F.col(c).isNull() for c in order], *order)).alias("first")).select("first.*")
    rows = keyed if known is None else keyed.join(known.select(key), key, "left_anti").select(*messages.columns)
    return rows.unionByName(messages.filter(F.col(key).isNull()))


def memo(fingerprints: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows with reuse: true where the stored fingerprint is unchanged and completed."""
    s = stored.select("id", F.col("fingerprint").alias("stored"), "completed")
    return fingerprints.join(s, "id", "left").select("id", "fingerprint", F.coalesce((F.col("stored") == F.col("fingerprint")) & F.col("completed"), F.lit(False)).alias("reuse"))


def numbered(rows: DataFrame, prefix: str, moment: str, key: str) -> DataFrame:
    """Gap-free references for each year in order of arrival: numbered within a quarter of an hour, after the quarters before it.

    Rows without a moment get no number and stay.
    """
    year, slot = F.year(moment), F.floor(F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(moment).cast("timestamp_ntz")) / 15)
    slots = rows.filter(F.col(moment).isNotNull()).groupBy(year.alias("_year"), slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("_year").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select("_slot", "_ahead")
    inside = rows.withColumn("_slot", slot).withColumn("_row", F.row_number().over(W.partitionBy("_slot").orderBy(moment, key)))
    numbers = F.when(F.col("_ahead").isNotNull(), F.format_string(f"{prefix}-%04d-%06d", year, F.col("_ahead") + F.col("_row")))
    return inside.join(slots, "_slot", "left").withColumn("reference", numbers).drop("_slot", "_row", "_ahead")
