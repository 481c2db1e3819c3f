"""Optional streaming intake: redelivered messages are dropped within a watermark, and arrivals are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_messages(stream: DataFrame, key: str = "message_id", moment: str = "received_at", late: str = "1 day") -> DataFrame:
    """The first delivery of each message; repeats are recognised as long as the watermark hasn't passed them."""
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, moment: str = "received_at", channel: str = "channel", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages by channel and tumbling window."""
    counts = stream.withWatermark(moment, late).groupBy(F.window(moment, width), channel).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("since"), channel, "n")
