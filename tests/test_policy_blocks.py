"""Policies are ranked among all that share a signal with a notice, in blocks."""

from __future__ import annotations

import datetime
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lossbook.functions import pairwise
from lossbook.functions.similarity import containment, jaccard, name_similarity, weighted_mean
from lossbook.operators import blocks, matching
from lossbook.plans import match_plans
from lossbook.thresholds import Thresholds
from test_candidate_scores import CASE, POLICY

SHOWN = ("case_id", "policy_id", "rank", "score", "strength", "overall", "candidates")


def test_a_policy_beyond_the_first_200_of_a_broker_is_ranked(spark, tmp_path):
    """The broker has 260 policies and the notice's own one sorts last: query and SQL find it."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT (i * 4999)::BIGINT AS c_custkey, 'Customer#' || lpad((i * 4999)::VARCHAR, 9, '0') AS c_name, 1 AS c_nationkey, 100.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(1, 261) t(i)")
    con.execute("CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, 227 * 4999::BIGINT AS o_custkey, 10.0::DOUBLE AS o_totalprice, TIMESTAMP '1999-05-05' AS o_orderdate FROM range(1, 5) t(k)")
    con.execute("CREATE TABLE nation AS SELECT 1 AS n_nationkey, 'FRANCE' AS n_name, 1 AS n_regionkey")
    con.execute("CREATE TABLE region AS SELECT 1 AS r_regionkey, 'EUROPE' AS r_name")
    for name in ("customer", "orders", "nation", "region"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = con.execute(match_plans.ORACLES["policy_match_ranked"]).fetchall()
    got = match_plans.policy_match_ranked(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    place = con.execute("SELECT count(*) FROM customer WHERE 1995 + c_custkey % 6 < 1995 + (227 * 4999) % 6").fetchone()[0]
    assert place > 200 and {r.case_id for r in got if r.policy_id == 227 * 4999 and r.rank == 0} == {1, 2, 3, 4}


def test_blocks_rank_as_pairs_do(spark, monkeypatch):
    """Texts of any kind, keys in one block or in many: the first five of all pairs as by column expressions."""
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    day = datetime.date(2001, 5, 5)
    names = ["", None, "Acme Ltd", "Acme Marine", "Zen\u00e9 Group", "Ox\x01a", "Ox \x02a", "\x02", "Acme Motor Company of the Northern Isles and the Southern Isles together with others", "Acma"]
    cases = [(i, pick("P-1", "p 12", None), pick(*names), pick(*names), pick("Big Broker", "big", None, " "), pick("A@x.com ", "b@x.com", "\x01b", None), pick("France", None), pick("motor", "m\x01\x02b", None),
              pick(datetime.datetime(2001, 2, 3), None), pick("Mill Road, France", "a", "", None)) for i in range(40)] + [(90, None, None, None, None, None, "France", "motor", datetime.datetime(2001, 5, 5), "x y")]
    policies = [(i - 5, pick(f"P-12{i % 4}", "P-1\x01\x02", None), pick(*names), pick(*names), pick("Big Broker Ltd", None), pick("BR-big broker/1", None), pick("a@x.com", "\x01b", None), pick("France", "Spain"),
                 pick("motor", "m\x01\x02b", None), pick(day.replace(year=2000), None), pick(day, None), pick("Unit mill france", "a", "", None)) for i in range(260)]
    c, p = spark.createDataFrame(cases, CASE), spark.createDataFrame(policies, POLICY)
    pairs = matching.policy_candidates(c, p, Thresholds(policy_candidates=100_000))
    want = sorted(map(tuple, matching.ranked_policies(matching.policy_scores(c, p, pairs)).select(*SHOWN).collect()))
    assert sorted(map(tuple, matching.foremost_policies(c, p).select(*SHOWN).collect())) == want and len(want) > 100
    monkeypatch.setattr(blocks, "BLOCK", 7)
    found = matching.foremost_policies(c, p).select(*SHOWN)
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, matching.ranked_policies(matching.candidate_scores(c, p)).select(*SHOWN).collect())) != want  # the first 200 alone don't tell


def test_texts_are_compared_as_by_column_expressions(spark):
    rng = random.Random(5)
    texts = ["", "a", "acme", "acme marine", "acne", "x" * 70, "y" * 40 + " " + "x" * 30, " ".join(f"w{k}" for k in range(30)), " ".join(f"w{k}" for k in range(10, 25))] + ["".join(rng.choice("abc ") for _ in range(12)).strip().replace("  ", " ") for _ in range(20)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    a, b, words = F.col("a"), F.col("b"), lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: w != "")
    rows = spark.createDataFrame([(texts[i], texts[j]) for i, j in pairs], "a string, b string").coalesce(1)
    want = rows.select(name_similarity(a, b), containment(words(a), words(b)), jaccard(words(a), words(b)), F.round(weighted_mean([(name_similarity(a, b), 1.3), (F.when(a != "", jaccard(words(a), words(b))), 0.7)]), 4)).collect()
    x, y = (np.array([p[k] for p in pairs]) for k in (0, 1))
    name, word = pairwise.Names(texts), pairwise.Words([" ".join(t.split()) for t in texts])
    alike = word.jaccard(x, y)
    score = pairwise.rounded(pairwise.mean([(name(x, y), 1.3), (np.where([texts[i] != "" for i in x], alike, np.nan), 0.7)]))
    assert [tuple(r) for r in want] == list(zip(name(x, y), word.containment(x, y), alike, score, strict=True))
    at, by = np.arange(len(texts))[:, None], np.arange(len(texts))[None, :]
    codes = np.arange(len(texts)) - 1
    grid = pairwise.compared(codes, codes, at, by, name)
    assert np.isnan(grid[0]).all() and np.array_equal(grid[1:, 1:].ravel(), np.array([name(np.array([i]), np.array([j]))[0] for i in codes[1:] for j in codes[1:]]))
    assert pairwise.rounded(np.array([0.12345, 0.00005, 2 / 3, 1.0, np.nan]))[:4].tolist() == [0.1235, 0.0001, 0.6667, 1.0]
