"""Intake of notices: deliveries told apart by two keys, and the text of a notice with its attachments within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.store import saved

COLUMNS = ["row_id", "idempotency_key", "message_id", "turn"]
#: The shortest share of a budget that an attachment gets.
LEAST_SHARE = 2000


def first_deliveries(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """row_id, created, existing: whether a message makes a case, and else which message did.

    messages: row_id (unique), moment, idempotency_key, message_id; known: the messages that made cases before, alike. In order of moment, then row_id, a message makes a
    case unless an earlier one that made a case had its key, or its message id; a message that makes none leaves none of its own keys behind. existing is by the key, else by the message id.

    Done in rounds: of the messages left, each that comes first for both its key and its id makes a case, and all that share one of these with it are repeats. Both
    firsts are partial aggregates, so a key that a third of all messages carry meets in no task; rounds follow the longest chain of messages that hold each other up, not the
    number of messages.

    Edge cases: a null key or id is shared with nobody; messages without both all make cases; a null moment comes first; repeated row_ids must be told apart beforehand; empty tables give no rows.
    """
    turn = F.struct("moment", "row_id").alias("turn")
    keyed = saved(messages.select("row_id", "idempotency_key", "message_id", turn), "messages")
    made = saved((messages.limit(0) if known is None else known).select("row_id", "idempotency_key", "message_id", turn), "messages-known")
    old, new = made, made
    waiting = keyed
    while True:
        for key in ("idempotency_key", "message_id"):
            waiting = waiting.join(new.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
        waiting = saved(waiting.join(new.select("row_id"), "row_id", "left_anti").select(*COLUMNS) if new is not old else waiting.select(*COLUMNS), "messages-waiting")
        if waiting.isEmpty():
            break
        firsts = waiting
        for key in ("idempotency_key", "message_id"):
            first = waiting.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("turn").alias(f"first_{key}"))
            firsts = firsts.join(first, key, "left")
        is_first = lambda key: F.col(key).isNull() | (F.col("turn") == F.col(f"first_{key}"))
        new = saved(firsts.filter(is_first("idempotency_key") & is_first("message_id")).select(*COLUMNS), "messages-new")
        made = made.unionByName(new)
    fresh = made.join(old.select("row_id"), "row_id", "left_anti") if known is not None else made
    rows = keyed.join(fresh.select("row_id", F.lit(True).alias("created")), "row_id", "left")
    for key in ("idempotency_key", "message_id"):
        owner = made.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("turn").alias(f"by_{key}"))
        rows = rows.join(owner, key, "left").withColumn(f"by_{key}", F.when(F.col("created").isNull() & (F.col(f"by_{key}") < F.col("turn")), F.col(f"by_{key}")))
    known_first = F.coalesce(F.col("by_idempotency_key.row_id"), F.col("by_message_id.row_id"))
    return rows.select("row_id", F.coalesce("created", F.lit(False)).alias("created"), known_first.alias("existing"))


def take_batch(path: str, keep: str | None = None):
    """A function for foreachBatch that adds a stream's new cases to the table at ``path``, one folder a batch.

    A batch is judged against what other batches stored, so a batch that runs again after a failure writes the same folder again: cases are made once. ``keep``, an interval
    such as ``30 days``, bounds what is remembered: repeats older than that before the batch's newest message aren't known any more.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = ["row_id", "moment", "idempotency_key", "message_id"]
        stored = _stored(spark, path, batch.select(*columns).schema)
        known = None if stored is None else stored.filter(F.col("batch") != number).select(*columns)
        rows = saved(batch.select(*columns), "batch")
        if known is not None and keep is not None:
            newest = rows.agg(F.max("moment").alias("newest"))
            known = known.join(F.broadcast(newest), F.col("moment") >= F.col("newest") - F.expr(f"interval '{keep}'")).drop("newest")
        judged = first_deliveries(rows, known)
        rows.join(judged.filter("created").select("row_id"), "row_id", "left_semi").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema.add("batch", "long")).option("basePath", path).parquet(path)


def budgeted(cases: DataFrame, attachments: DataFrame, budget: int, most: int = 40) -> DataFrame:
    """case_id, corpus, n_attachments: a notice with the beginnings of its attachments, in order, as far as the budget of characters goes.

    cases: case_id, notice; attachments: case_id, nth, text. The notice goes in whole. Each attachment in turn gets what is left divided by the number of all of them,
    ``LEAST_SHARE`` at least, while anything is left. Shares are folded over the lengths alone; texts are cut before they are put together, so a case holds about a budget of text and a share at most.

    Edge cases: a null notice or text is empty; a case has ``most`` attachments at most, the first ones; attachments of no case are left out; a case without any has its notice.
    """
    first = attachments.withColumn("n", F.row_number().over(W.partitionBy("case_id").orderBy("nth"))).filter(F.col("n") <= most)
    texts = first.select("case_id", "n", F.coalesce("text", F.lit("")).alias("text"))
    lengths = texts.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", F.length("text").alias("size")))).alias("sizes"))
    notice = F.btrim(F.coalesce("notice", F.lit("")), F.lit(" \t\r\n\x0b\x0c"))
    held = cases.select("case_id", notice.alias("notice")).join(lengths, "case_id", "left")
    start = F.struct(F.greatest(F.lit(0), budget - F.length("notice")).alias("left"), F.array().cast("array<int>").alias("shares"))

    def take(state, item):
        share = F.when(state["left"] > 0, F.least(item["size"], F.greatest(F.lit(LEAST_SHARE), F.floor(state["left"] / F.size("sizes")).cast("int")))).otherwise(-1)
        return F.struct((state["left"] - F.greatest(share, F.lit(0))).alias("left"), F.array_append(state["shares"], share).alias("shares"))

    shares = F.aggregate(F.coalesce("sizes", F.array().cast(lengths.schema["sizes"].dataType)), start, take, lambda s: s["shares"])
    held = held.select("case_id", "notice", shares.alias("shares"))
    given = held.select("case_id", F.posexplode("shares").alias("at", "share")).filter("share >= 0").select("case_id", (F.col("at") + 1).alias("n"), "share")
    cut = texts.join(given, ["case_id", "n"]).select("case_id", "n", F.concat(F.lit("\n\n--- ATTACHMENT "), F.col("n").cast("string"), F.lit(" ---\n"), F.left("text", F.col("share"))).alias("part"))
    parts = cut.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    rows = held.join(parts, "case_id", "left")
    return rows.select(
        "case_id", F.concat("notice", F.coalesce(F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit(""))).alias("corpus"), F.coalesce(F.size("parts"), F.lit(0)).alias("n_attachments")
    )
