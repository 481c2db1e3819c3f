"""Literal expectations for expressions, and properties of the similarities."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lossbook.functions import parsing, similarity, text


def values(spark, rows, kind, expression):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("x"))).collect()]


def test_dates(spark):
    day = datetime.date(2026, 8, 7)
    got = values(spark, ["20260807", "07/08/2026", "2026-08-07", "7 August 2026", "7th Aug 2026", "not a date", "2026-13-45", None, "2026-08-07T10:00:00Z"], "string", parsing.parse_date)
    assert got == [day, day, day, day, day, None, None, None, day]


def test_money(spark):
    got = values(spark, ["GBP 128,000", "£430,000", "2.4m", "40k", "-40000", "no idea", None], "string", parsing.parse_money_minor)
    assert got == [12800000, 43000000, 240000000, 4000000, None, None, None]
    assert values(spark, ["£5", "S$5", "eur", "?"], "string", parsing.parse_currency) == ["GBP", "USD", "EUR", "GBP"]


def test_counts_and_words(spark):
    assert values(spark, ["none", "2 people", "lots", "no injuries", None], "string", parsing.parse_count) == [0, 2, None, 0, None]
    assert values(spark, ["yes", "nil", "maybe"], "string", parsing.parse_bool) == [True, False, None]
    assert values(spark, ["Employers Liability", "AUTO", "spaceflight", None], "string", parsing.parse_line_of_business) == ["liability", "motor", None, None]
    assert values(spark, ["Policyholder", "Police", "x", None], "string", parsing.parse_party_role) == ["insured", "authority", "other", "other"]
    assert values(spark, ["Café  Ltd ", None, "Škoda ﬁre Čapek ŐŰ", "e\u0301té"], "string", text.normalise) == ["cafe ltd", "", "skoda fire capek ou", "ete"]
    assert values(spark, ["Northline Logistics Ltd", "Group Holdings", None], "string", text.normalise_organisation) == ["northline logistics", "", ""]
    assert values(spark, ["jo@big-firm.co.uk", "jo@gmail.com", "x"], "string", text.organisation_from_email) == ["Big Firm", None, None]
    assert values(spark, ["FNOL-2026-000412", "fnol-26-1"], "string", lambda c: text.parse_reference(c)["number"]) == [412, None]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_sequences(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))), "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14)))) for _ in range(60)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = frame.orderBy("i").select(similarity.lcs_length(F.col("a"), F.col("b")), similarity.sequence_ratio(F.col("a"), F.col("b")), similarity.sequence_ratio(F.col("b"), F.col("a"))).collect()
    for (a, b), (n, ratio, back) in zip(pairs, got, strict=True):
        assert n == lcs(a, b) == similarity._common_letters(a, b) and 0 <= ratio <= 1 and ratio == pytest.approx(back)


def test_similarities(spark):
    row = spark.range(1).select(
        similarity.compared_names(F.lit("Northline Logistics Ltd"), F.lit("Northline Logistics Limited")).alias("same"),
        similarity.compared_names(F.lit(""), F.lit("x")).alias("none"), similarity.haversine_km(F.lit(53.8008), F.lit(-1.5491), F.lit(53.9591), F.lit(-1.0815)).alias("km"),
        similarity.weighted_mean([(F.lit(1.0), 2), (F.lit(None).cast("double"), 5)]).alias("mean"), similarity.noisy_or(F.array(F.lit(0.3), F.lit(0.25))).alias("either"),
    ).first()
    assert row.same == 1.0 and row.none is None and 30 < row.km < 45 and row.mean == 1.0 and row.either == pytest.approx(0.475)


def test_common_letters_of_many_pairs():
    """Bit rows of many pairs at once, of single pairs, and plain dynamic programming agree, over lengths around a machine word's and letters beyond 16 bits."""
    import pandas as pd

    from lossbook.functions import similarity

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = following(row, x, b)
        return row[-1]

    def following(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    rng = random.Random(8)
    name = lambda n: "".join(rng.choice("ab cé\U0001f600") for _ in range(n))
    pairs = [(name(rng.randrange(0, 70)), name(rng.randrange(0, 70))) for _ in range(150)] + [("", ""), ("a", ""), ("", "a"), ("a" * 63, "a" * 63), ("a" * 64, "b" + "a" * 64)]
    a, b = pd.Series([p for p, _ in pairs] + [None, "x"]), pd.Series([q for _, q in pairs] + ["x", None])
    got = similarity._common_batch(a, b)
    assert got.isna().tolist()[-2:] == [True, True] and [int(x) for x in got[:-2]] == [plain(p, q) for p, q in pairs] == [similarity._common_letters(p, q) for p, q in pairs]
