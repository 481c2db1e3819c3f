"""Queues, boards, tiles and trails: filters, ordered pages and one-pass aggregates over a whole book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.functions.text import title_case
from lossbook.vocab import CURRENCY_SIGNS, BLOCKING_CODES, REVIEW_STATUSES

SEVERITY_ORDER = ("critical", "high", "medium", "low")
PRIORITY_ORDER = ("urgent", "high", "standard", "routine")
FACETS = ("received", "needs_review", "policy_match_required", "possible_duplicate", "ready_for_claim", "claim_created")


def rank(value: Column, order: Sequence[str]) -> Column:
    """Position in an order, one past its end for anything else."""
    out = F.when(value == order[0], 0)
    for n, name in enumerate(order[1:], 1):
        out = out.when(value == name, n)
    return out.otherwise(len(order))


def one_of(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose column is among values; no values, no filter."""
    return df.filter(F.col(column).isin(*values)) if values else df


def search(df: DataFrame, query: str | None, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns; % and _ keep their meaning."""
    if not query or not query.strip():
        return df
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.col(column).ilike(f"%{query.strip()}%"), F.lit(False))
    return df.filter(hit)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def claims_queue(
    claims: DataFrame, as_of: str, statuses: Sequence[str] | None = None, severities: Sequence[str] | None = None, fraud: bool = False,
    catastrophe: bool = False, handler: int | None = None, query: str | None = None, number: int = 1, size: int = 25,
) -> DataFrame:
    """A page of the claim queue, most urgent first, as summaries."""
    rows = one_of(one_of(claims, "status", statuses), "severity", severities)
    rows = rows.filter("fraud_review") if fraud else rows
    rows = rows.filter("cat_event_id is not null") if catastrophe else rows
    rows = rows.filter(F.col("handler_id") == handler) if handler is not None else rows
    rows = search(rows, query, ("reference", "insured_name", "policy_number", "loss_type", "currency"))
    rows = page(rows, (rank(F.col("priority"), PRIORITY_ORDER), F.col("reported_at").desc_nulls_last(), F.col("claim_id")), number, size)
    return rows.select(
        "claim_id", "reference", "status", "priority", "insured_name", title_case(F.col("loss_type")).alias("loss_title"), "reserve_minor", "currency",
        age_days(F.col("status"), F.col("reported_at"), as_of).alias("age_days"),
    )


def age_days(status: Column, reported: Column, as_of: str) -> Column:
    """Whole days since the report, null once a claim is closed."""
    days = F.floor(F.timestamp_diff("MICROSECOND", reported, F.lit(as_of).cast("timestamp_ntz")) / 86_400_000_000)
    return F.when(~status.isin("approved", "rejected"), F.greatest(F.lit(0), days)).cast("long")


def status_facets(cases: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """position, facet, n: all, then each facet in lifecycle order, zero-filled, from one aggregate row."""
    counts = cases.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in facets])
    names = ["all", *facets]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("facet"), F.col(s).alias("n")) for i, s in enumerate(names)])
    return counts.select(F.inline(rows))


def claims_tiles(claims: DataFrame) -> DataFrame:
    """All tiles of the claim list in one pass."""
    is_open = ~F.col("status").isin("approved", "rejected")
    return claims.agg(
        F.count(F.lit(1)).alias("claims"), F.coalesce(F.sum(F.when(is_open, F.col("reserve_minor"))), F.lit(0)).alias("open_exposure_minor"),
        F.count_if("fraud_review").alias("fraud_review"), F.count_if("over_authority").alias("over_authority"),
        F.count_if(F.col("cat_event_id").isNotNull()).alias("cat_linked"),
    )


def exposure_by_currency(claims: DataFrame) -> DataFrame:
    """Open exposure without mixing currencies."""
    is_open = ~F.col("status").isin("approved", "rejected")
    return claims.filter(is_open).groupBy("currency").agg(F.sum("reserve_minor").alias("open_exposure_minor"), F.count(F.lit(1)).alias("claims"))


def intake_queue(
    cases: DataFrame, statuses: Sequence[str] | None = None, channels: Sequence[str] | None = None, needs_review: bool = False, unassigned: bool = False,
    query: str | None = None, number: int = 1, size: int = 25,
) -> DataFrame:
    rows = one_of(one_of(cases, "status", statuses), "channel", channels)
    rows = rows.filter(F.col("status").isin(*REVIEW_STATUSES)) if needs_review else rows
    rows = rows.filter("assigned_to is null") if unassigned else rows
    rows = search(rows, query, ("reference", "insured_name", "policy_number", "loss_location", "reporter_organisation", "external_reference"))
    order = (rank(F.col("severity"), SEVERITY_ORDER), F.col("received_at").desc_nulls_last(), F.col("case_id"))
    return page(rows, order, number, size).select("case_id", "reference", "status", "channel", "severity", "received_at", "insured_name")


def board_metrics(cases: DataFrame, exceptions: DataFrame, since: str) -> DataFrame:
    """The intake board in one row: each table is read once."""
    by_case = exceptions.filter("status = 'open'").groupBy("case_id").agg(F.max((F.col("code") == "no_policy_match").cast("int")).alias("no_policy"))
    open_ = by_case.agg(F.count(F.lit(1)).alias("with_open_exceptions"), F.coalesce(F.sum("no_policy"), F.lit(0)).alias("no_policy"))
    totals = cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*REVIEW_STATUSES)).alias("needs_review"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_severity"), F.count_if(F.col("status") != "received").alias("processed"),
        F.count_if(F.col("status") == "claim_created").alias("converted"), F.count_if(F.col("received_at") >= F.lit(since).cast("timestamp_ntz")).alias("received_recently"),
    )
    return totals.crossJoin(open_).withColumn("with_policy", F.greatest(F.lit(0), F.col("total") - F.col("no_policy")))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def cases_by_open_code(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter("status = 'open'").groupBy("code").agg(F.count_distinct("case_id").alias("cases"))


def case_title(line: Column, loss_type: Column, description: Column, location: Column) -> Column:
    """Loss type, else the first sentence, else the line; then the last part of the location."""
    sentence = F.left(F.btrim(F.get(F.split(description, r"\."), 0)), F.lit(60))
    head = F.coalesce(title_case(loss_type), F.nullif(sentence, F.lit("")), title_case(line), F.lit("Notice"))
    place = F.btrim(F.element_at(F.split(location, ","), -1))
    return F.concat_ws(" — ", head, F.nullif(place, F.lit("")))


def case_summaries(cases: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Each case with its title and its open and blocking exceptions."""
    per_case = exceptions.filter("status = 'open'").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("open_exceptions"), F.count_if(F.col("code").isin(*BLOCKING_CODES)).alias("blocking_exceptions")
    )
    title = case_title(F.col("line_of_business"), F.col("loss_type"), F.col("loss_description"), F.col("loss_location"))
    return cases.join(per_case, "case_id", "left").select(
        "case_id", "reference", title.alias("title"), F.coalesce("open_exceptions", F.lit(0)).cast("long").alias("open_exceptions"),
        F.coalesce("blocking_exceptions", F.lit(0)).cast("long").alias("blocking_exceptions"),
    )


def audit_trail(events: DataFrame, entities: Sequence[int], size: int = 200) -> DataFrame:
    """The newest entries of an entity and those linked to it."""
    return events.filter(F.col("user_id").isin(*entities)).orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(size).select("event_id", "ts", "user_id", "event_type")


def policies_by_number(policies: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted.number -> policies with the same normal form. An equi-join on the stored form."""
    normal = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return wanted.withColumn("key", normal(F.col("number"))).join(policies.withColumn("key", normal(F.col("policy_number"))), "key")


def money(minor: Column, currency: Column) -> Column:
    """Compact amounts: £4.82m, $128k, €1.2k, £940; other currencies have no sign."""
    sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair]), currency), F.lit(""))
    units = minor / 100
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"0+$", ""), r"\.$", "")
    millions = F.concat(trim(F.format_number(units / 1e6, 2)), F.lit("m"))
    thousands = F.concat(trim(F.format_number(units / 1e3, 1)), F.lit("k"))
    whole = F.format_string("%,d", F.bround(units, 0).cast("long"))
    return F.when(minor.isNotNull(), F.concat(sign, F.when(F.abs(units) >= 1e6, millions).when(F.abs(units) >= 1e3, thousands).otherwise(whole)))
