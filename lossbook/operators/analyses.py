"""Stored analyses: one result for each case and kind, kept as a VARIANT, and read back as it was concluded then, not computed again.

Edge cases: a result that isn't JSON, or isn't there, is null and reads back as one without any values; values that are missing, null or of another type than asked get the reader's default; of two results of a case
and kind the newer one stays, of one moment the one whose provider, then text, comes last; null case_ids or kinds are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["case_id", "kind"]


def record(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """case_id, kind, provider, confidence, updated_at, result (VARIANT): the stored rows with the new ones over them. new has result as JSON text; stored is what this returned before."""
    held = ["provider", "confidence", "updated_at"]
    rows = new.filter("case_id is not null and kind is not null").select(*KEY, *held, "result")
    if stored is not None:
        rows = rows.unionByName(stored.select(*KEY, *held, F.to_json("result").alias("result")))
    order = F.struct("updated_at", F.coalesce("provider", F.lit("")).alias("p"), F.coalesce("result", F.lit("")).alias("r"))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*held, "result"), order).alias("a"))
    return last.select(*KEY, *[f"a.{c}" for c in held], F.try_parse_json("a.result").alias("result"))


def at(path: str, kind: str = "string", default: object = None) -> Column:
    """The value at a path of the result, or the default."""
    found = F.try_variant_get("result", path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def _listed(path: str, defaults: dict[str, object]) -> Column:
    """The objects of a list, each with its defaults; what isn't an object of a list is left out."""
    kinds = {name: "double" if isinstance(value, float) else "string" for name, value in defaults.items()}
    items = F.coalesce(F.try_variant_get("result", path, "array<variant>"), F.array().cast("array<variant>"))
    read = lambda x: F.struct(*[F.coalesce(F.try_variant_get(x, f"$.{n}", k), F.lit(defaults[n])).alias(n) for n, k in kinds.items()])
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), read)


def coverage(analyses: DataFrame) -> DataFrame:
    """case_id, indicator, confidence, reasoning, checks, completed_at, produced_by as they were concluded."""
    checks = _listed("$.checks", {"key": "", "label": "", "state": "unknown", "detail": ""})
    return analyses.filter("kind = 'coverage'").select(
        "case_id", at("$.indicator", default="insufficient_information").alias("indicator"), "confidence", at("$.reasoning", default="").alias("reasoning"), checks.alias("checks"),
        F.col("updated_at").alias("completed_at"), F.col("provider").alias("produced_by"),
    )


def fraud(analyses: DataFrame) -> DataFrame:
    """case_id, level, score, indicators as they were concluded."""
    indicators = _listed("$.indicators", {"code": "", "title": "", "detail": "", "weight": 0.0})
    return analyses.filter("kind = 'fraud'").select("case_id", at("$.level", default="low").alias("level"), at("$.score", "double", 0.0).alias("score"), indicators.alias("indicators"))


def raw_loss_date(analyses: DataFrame) -> DataFrame:
    """case_id, raw: the loss date as the extraction read it."""
    return analyses.filter("kind = 'extraction'").select("case_id", at("$.loss.date_of_loss.value").alias("raw"))
