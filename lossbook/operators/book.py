"""Reads of a whole book at once: lookups, nested children, histories, workloads, and the written summary of a notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.functions.text import normalise_reference


def by_reference(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose reference is one of wanted.reference, read trimmed and in capitals; null and blank references find nothing."""
    keys = wanted.select(F.upper(F.btrim("reference")).alias("reference")).filter("reference <> ''").distinct()
    return rows.join(keys, "reference", "left_semi")


def with_children(cases: DataFrame, fields: DataFrame, exceptions: DataFrame) -> DataFrame:
    """case_id, reference, fields (in field order) and exceptions (oldest first) as arrays; a case without children has empty ones."""
    read = fields.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("field_no", "value", "confidence"))).alias("fields"))
    raised = exceptions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "code", "status"))).alias("exceptions"))
    rows = cases.select("case_id", "reference").join(read, "case_id", "left").join(raised, "case_id", "left")
    none = F.array()
    return rows.select("case_id", "reference", F.coalesce("fields", none.cast(read.schema["fields"].dataType)).alias("fields"), F.coalesce("exceptions", none.cast(raised.schema["exceptions"].dataType)).alias("exceptions"))


def listed(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows: the cap is what a list shows, as the reader asks for it."""
    return rows.orderBy(*order).limit(most)


def same_policy(claims: DataFrame, shown: int = 6) -> DataFrame:
    """claim_id, other_id, nth: of the newest ``shown`` claims of a claim's policy those that aren't itself. One list for each policy, not pairs of its claims."""
    keyed = claims.withColumn("key", normalise_reference(F.col("policy_number"))).filter("key <> ''")
    newest = W.partitionBy("key").orderBy(F.col("reported_at").desc_nulls_last(), F.col("claim_id").desc())
    history = keyed.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= shown).select("key", F.col("claim_id").alias("other_id"), "nth")
    return keyed.select("claim_id", "key").join(history, "key").filter("claim_id <> other_id").select("claim_id", "other_id", "nth")


def scoped(claims: DataFrame, handler: int | None = None, fraud_only: bool = False, cat_only: bool = False) -> DataFrame:
    """Claims a reader may see or asked for: one handler's, under fraud review, or linked to a catastrophe."""
    tests = [(handler is not None, F.col("handler_id") == handler), (fraud_only, F.col("fraud_review")), (cat_only, F.col("cat_event_id").isNotNull())]
    for asked, test in tests:
        claims = claims.filter(test) if asked else claims
    return claims


def workload(handlers: DataFrame, claims: DataFrame, closed: tuple[str, ...] = ("approved", "rejected")) -> DataFrame:
    """handler_id, full_name, open_claims as counted, capacity and headroom; handlers without claims have none open."""
    held = claims.filter(~F.col("status").isin(*closed)).groupBy("handler_id").agg(F.count(F.lit(1)).alias("held"))
    open_ = F.coalesce("held", F.lit(0))
    return handlers.join(held, "handler_id", "left").select("handler_id", "full_name", open_.alias("open_now"), "capacity", F.greatest(F.lit(0), F.col("capacity") - open_).cast("long").alias("headroom"))


def coverage(rows: DataFrame, columns: list[str]) -> Column:
    """Share of the columns that have a value, two places."""
    kinds = dict(rows.dtypes)
    present = [(F.coalesce(F.btrim(c) != "", F.lit(False)) if kinds[c] == "string" else F.col(c).isNotNull()).cast("int") for c in columns]
    return F.round(sum(present[1:], present[0]) / len(columns), 2)


def _casualties(injuries: Column, fatalities: Column) -> Column:
    dead = F.when(fatalities > 0, F.concat(fatalities.cast("string"), F.when(fatalities == 1, " fatality").otherwise(" fatalities")))
    hurt = F.when(injuries > 0, F.concat(injuries.cast("string"), F.when(injuries == 1, " person injured").otherwise(" people injured")))
    text = F.concat_ws(" and ", dead, hurt)
    return F.when(text != "", F.concat(text, F.lit("."))).when((injuries == 0) & (fatalities == 0), "No injuries or fatalities were reported.").otherwise("No injuries reported.")


def summary_text(currency: str = "GBP") -> Column:
    """The paragraph of a claims file: what was reported and by whom, when and where, what it is thought to cost, what is outstanding.

    Needs beside the case: matched_number, effective_date, expiry_date, event_name, score and missing of completeness.
    """
    said = lambda c: F.nullif(c, F.lit(""))
    after = lambda lead, c: F.coalesce(F.concat(F.lit(lead), c), F.lit(""))
    description = said(F.left(F.btrim("loss_description"), F.lit(400)))
    first = F.when(description.endswith("."), description).otherwise(F.concat(description, F.lit(".")))
    organisation = F.concat(F.lit("("), said(F.col("reporter_organisation")), F.lit(")"))
    reporter = said(F.btrim(F.concat_ws(" ", said(F.col("reporter_name")), organisation)))
    insured = F.coalesce(said(F.col("insured_name")), said(F.col("insured_organisation")))
    policy = F.coalesce(F.concat(F.lit(" against policy "), said(F.col("policy_number"))), F.lit(", with no policy identified"))
    reported = F.concat(
        F.when(description.isNotNull(), "Reported").otherwise("A loss was reported"), after(" by ", reporter), after(" for ", insured), policy,
        after(" at ", said(F.col("loss_location"))), after(", loss dated ", F.date_format("date_of_loss", "dd MMMM yyyy")), F.lit("."),
    )
    estimate = F.when(F.col("estimated_loss_minor") != 0, F.concat(F.lit(f"Initial estimated loss is {currency} "), F.format_number(F.col("estimated_loss_minor") / 100, 0), F.lit(".")))
    matched = F.when(F.col("matched_number").isNull(), "No policy has been matched to the notification.").otherwise(
        F.concat(F.lit("The matched policy "), F.col("matched_number"), F.lit(" ran "), F.date_format("effective_date", "dd MMM yyyy"), F.lit(" to "), F.date_format("expiry_date", "dd MMM yyyy"), F.lit("."))
    )
    event = F.concat(F.lit("The loss may be attributable to "), F.col("event_name"), F.lit("."))
    missing = F.array_join(F.slice("missing", 1, 4), ", ")
    complete = F.concat(F.lit("Documentation is "), F.format_number(F.col("score") * 100, 0), F.lit("% complete"), F.when(missing == "", ".").otherwise(F.concat(F.lit("; still missing "), missing, F.lit("."))))
    return F.concat_ws(" ", first, reported, estimate, matched, event, _casualties(F.col("injuries"), F.col("fatalities")), complete)
