"""Officers' edits as a log that is only added to: what a case says at any time, and what each edit changed.

An edit names a field by its path and gives a text; it is read as the field's kind asks (dates, amounts, counts, contacts and flags as the notice reader reads them). An edit
is refused if the path can't be edited, if its text can't be read, or if the case became a claim before it. Edits of one field follow one another by moment, then number, whenever they
arrive; one that sets what is there already changes nothing and leaves no audit row. An edit delivered twice (same number) counts once.

The value before an edit is that of the edit before it, of the same field. Within a day that is a window; over days it is the last value of each day, found by a partial aggregate and carried
on, so a field with a third of all edits meets in no task but by its days. The state at a time needs no order at all: the latest edit of each field up to it.

Edge cases: an empty or null text empties a field (a flag can't be empty and refuses it); edits without a case, a path or a moment are refused; two edits of one
moment go by number; a field with neither value nor edits isn't in the state; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.functions.parsing import parse_bool, parse_count, parse_datetime, parse_email, parse_money_minor, parse_phone
from lossbook.vocab import EDIT_LIMIT, EDIT_LIMITS, EDITABLE

KEY = ["case_id", "path"]


def _read() -> Column:
    """The value of an edit as it is kept, null where it can't be read as its kind."""
    text = F.btrim("raw")
    limits = F.coalesce(*[F.when(F.col("path") == p, n) for p, n in EDIT_LIMITS.items()], F.lit(EDIT_LIMIT))
    kinds = {
        "text": F.left(text, limits), "email": parse_email(text), "phone": parse_phone(text), "count": parse_count(text).cast("string"),
        "datetime": F.date_format(parse_datetime(text, text, F.col("moment")), "yyyy-MM-dd'T'HH:mm:ss"), "money": parse_money_minor(text).cast("string"), "flag": parse_bool(text).cast("string"),
    }
    return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in kinds.items()])


def read_edits(edits: DataFrame, converted: DataFrame) -> DataFrame:
    """Each edit once with kind, value, display and refused (why, or null). edits: change_id, case_id, path, raw, moment, actor, reason; converted: case_id, converted_at."""
    whole = F.struct("moment", "case_id", "path", "raw", "actor", "reason")
    once = edits.groupBy("change_id").agg(F.min(whole).alias("e")).select("change_id", "e.*")
    known = F.create_map(*[F.lit(x) for pair in EDITABLE.items() for x in pair])
    claims = converted.groupBy("case_id").agg(F.min("converted_at").alias("converted_at"))
    rows = once.join(claims, "case_id", "left").withColumn("kind", F.element_at(known, F.col("path")))
    rows = rows.withColumn("text", F.nullif(F.btrim("raw"), F.lit(""))).withColumn("value", F.when(F.col("text").isNotNull(), _read()))
    unread = F.when(F.col("text").isNull(), F.col("kind") == "flag").otherwise(F.col("value").isNull())
    refused = (
        F.when(F.col("case_id").isNull() | F.col("path").isNull() | F.col("moment").isNull(), "incomplete").when(F.col("kind").isNull(), "not_editable")
        .when(F.col("moment") >= F.col("converted_at"), "converted").when(unread, "not_readable")
    )
    shown = F.when(F.col("kind") == "money", F.when(F.col("value").isNotNull(), F.col("text"))).otherwise(F.col("value"))
    return rows.withColumn("display", shown).withColumn("refused", refused).drop("converted_at", "text")


def state_as_of(initial: DataFrame, read: DataFrame, moment: Column) -> DataFrame:
    """case_id, path, value, human_modified, original_value: each field's latest edit up to a moment over what it held before any. initial: case_id, path, value."""
    turn = F.struct("moment", "change_id")
    latest = read.filter(F.col("refused").isNull() & (F.col("moment") <= moment)).groupBy(*KEY).agg(F.max_by(F.struct("value"), turn).alias("last"))
    rows = initial.withColumnRenamed("value", "held").join(latest, KEY, "full")
    value = F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col("held"))
    return rows.select(*KEY, value.alias("value"), F.col("last").isNotNull().alias("human_modified"), F.when(F.col("last").isNotNull(), F.col("held")).alias("original_value"))


def audit_diffs(initial: DataFrame, read: DataFrame) -> DataFrame:
    """change_id, case_id, path, moment, actor, reason, before, after, nth of each edit that changed a field; nth counts a field's changes of one day.

    before and after are null for an empty field; amounts are shown as they were typed, in minor units where nobody typed them.
    """
    good = read.filter("refused is null").withColumn("day", F.to_date("moment"))
    turn = F.struct("moment", "change_id")
    now = F.struct("value", "display")
    days = good.groupBy(*KEY, "day").agg(F.max_by(now, turn).alias("end"))
    ahead = W.partitionBy(*KEY).orderBy("day")
    start = days.withColumn("yesterday", F.lag("end").over(ahead)).withColumn("first_day", F.row_number().over(ahead) == 1).select(*KEY, "day", "yesterday", "first_day")
    held = initial.select(*KEY, F.struct("value", F.col("value").alias("display")).alias("held"))
    start = start.join(held, KEY, "left").withColumn("start", F.when(F.col("first_day"), F.col("held")).otherwise(F.col("yesterday"))).select(*KEY, "day", "start")
    in_day = W.partitionBy(*KEY, "day").orderBy("moment", "change_id")
    before = F.coalesce(F.lag(now).over(in_day), F.col("start"))
    rows = good.join(start, [*KEY, "day"]).withColumn("was", before).filter(~F.col("value").eqNullSafe(F.col("was.value")))
    return rows.select(
        "change_id", *KEY, "moment", "actor", "reason", F.col("was.display").alias("before"), F.col("display").alias("after"), F.row_number().over(in_day).alias("nth")
    )
