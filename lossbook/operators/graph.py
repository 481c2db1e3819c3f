"""The knowledge graph of every claim at once: long tables of nodes and edges, one projection for each section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def build(claims: DataFrame, policies: DataFrame, handlers: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (claim_id, node_id, type, label, flag) and edges (claim_id, src, rel, dst); edges need both ends and are no loops."""
    p = policies.select("policy_id", "primary_location", F.col("status").alias("policy_status"))
    h = handlers.select(F.col("handler_id").alias("own_handler"), "full_name")
    e = events.select("event_id", F.col("reference").alias("event_reference"))
    rows = (
        claims.join(p, F.col("custkey") == F.col("policy_id"), "left").join(h, F.col("handler_id") == F.col("own_handler"), "left")
        .join(e, F.col("cat_event_id") == F.col("event_id"), "left")
    )
    claim, policy, insured = _named("claim", F.col("reference")), _named("policy", F.col("policy_number")), _named("insured", F.col("insured_name"))
    incident, place = _named("incident", F.col("claim_id")), _named("location", F.col("primary_location"))
    handler, event = _named("handler", F.col("own_handler")), _named("event", F.col("event_reference"))
    covered = F.col("policy_id").isNotNull()

    def node(test: Column | None, name: Column, kind: str, label: Column, flag: Column | None = None) -> Column:
        made = F.struct(name.alias("node_id"), F.lit(kind).alias("type"), label.alias("label"), (F.lit(None).cast("string") if flag is None else flag).alias("flag"))
        return made if test is None else F.when(test, made)

    nodes = [
        node(None, claim, "claim", F.col("reference"), F.when(F.col("fraud_review"), "watch")),
        node(covered, policy, "policy", F.col("policy_number"), F.when(F.col("policy_status") != "active", "watch")),
        node(covered, insured, "organisation", F.col("insured_name")), node(None, incident, "incident", F.coalesce("loss_type", F.lit("incident"))),
        node(place.isNotNull(), place, "location", F.col("primary_location")), node(handler.isNotNull(), handler, "person", F.col("full_name")),
        node(event.isNotNull(), event, "catastrophe", F.col("event_reference")),
    ]
    edges = [
        (covered, claim, "COVERED_BY", policy), (covered, policy, "ISSUED_TO", insured), (F.lit(True), claim, "CAUSED_BY", incident), (place.isNotNull(), incident, "OCCURRED_AT", place),
        (handler.isNotNull(), claim, "ASSIGNED_TO", handler), (event.isNotNull(), incident, "MATCHES", event),
    ]
    made = [F.when(t & (a != b), F.struct(a.alias("src"), F.lit(r).alias("rel"), b.alias("dst"))) for t, a, r, b in edges]
    present = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    return (
        rows.select("claim_id", F.inline(present(nodes))).dropDuplicates(["claim_id", "node_id"]),
        rows.select("claim_id", F.inline(present(made))).dropDuplicates(),
    )


def summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type").isin("organisation", "person")).alias("parties"), F.count_if(F.col("flag") == "watch").alias("watched")
    )
