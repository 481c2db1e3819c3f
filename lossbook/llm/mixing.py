"""Mixing sources to target weights by capped water-filling.

Every source gets ``weight * level`` words, but at most ``max_epochs`` times its
own size; the level is the one at which the targets add up to the budget, so
the excess of capped sources goes to the others by weight until none is above
its cap. A source's target is met with whole repetitions of all its documents
and one seeded draw for the fraction: documents in seeded order take one more
copy until the target is reached, each taken if its middle falls within it.

Edge cases: null or empty text has size 0 and is taken 0 words, and a source of such texts only gets no
repetition; a null source is a source of its own and comes last; rows are drawn by doc_id and text, so null or
repeated doc_ids spread over the bins too, and rows equal in both are ordered by size;
an empty table gives no rows; other columns are ignored. Cumulative sums run
over at most ``BINS`` rows for each source, then over the documents of one bin,
so a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lossbook.llm.store import saved

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size -> target. One row a source; sources are a configuration, far fewer than documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("weight", cycle)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", level)
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("water"), "cap")).alias("target"))
    )


def mix_sources(
    docs: DataFrame, seed: str = "mix", text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (long), taken (long)."""
    row = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    draw = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    sized = saved(docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), draw.alias("draw")), "mix-sizes").withColumn(
        "bin", F.shiftright("draw", 20).cast("int")
    )
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    dealt = (
        bins.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        .withColumn("end", F.sum("bin_size").over(upto))
        .withColumn("left", F.col("extra") - (F.col("end") - F.col("bin_size")))
    )
    rows = sized.alias("d").join(
        dealt.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bin") == F.col("b.bin"))
    ).select("d.doc_id", "d.source", "d.size", "d.draw", "d.bin", "source_size", "target", "whole", "extra", "bin_size", "left")
    inside = W.partitionBy("source", "bin").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    split = (F.col("left") > 0) & (F.col("left") < F.col("bin_size"))
    sure = rows.filter(~split).withColumn("more", ((F.col("left") >= F.col("bin_size")) & (F.col("extra") > 0)).cast("long"))
    cut = rows.filter(split).withColumn("more", (F.sum("size").over(inside) - F.col("size") / 2 <= F.col("left")).cast("long"))
    epochs = F.col("whole") + F.col("more")
    return sure.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken")
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
w AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(weight * water, cap)) AS target FROM w),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
"""
