"""Url rules against every rule tried on every url."""

from __future__ import annotations

import random
import re

import pytest

from lossbook.llm import url_rules


def split(url):
    """Host and path as the module's docstring says."""
    at = (url or "").find("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups() if at >= 0 else ("", "")
    return "".join(c.lower() if c.isascii() else c for c in host), path


def judged(url, rules, default="allow"):
    host, path = split(url)
    best = None
    for h, p, v in rules:
        if None in (h, p, v):
            continue
        h = "".join(c.lower() if c.isascii() else c for c in h)
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h) + len(p), len(h), h + p, v == "block", v))
    return (host, path, best[2], best[4]) if best else (host, path, None, default)


def random_table(rng):
    hosts = [".".join(rng.choice(("org", "com", "a", "b", "ab", "", "é")) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    paths = ["", "/"] + ["/" + "".join(rng.choice("ab/é.") for _ in range(rng.randrange(6))) for _ in range(40)]
    rules = [(rng.choice(hosts), rng.choice(paths)[: rng.randrange(8)], rng.choice(("allow", "block"))) for _ in range(150)]
    urls = [f"{rng.choice(('http', 'HTTPS', ''))}://{rng.choice(hosts).upper() if rng.random() < 0.3 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', '?q=/a', '#x', '?'))}" for _ in range(1200)]
    urls += [None, "", "no scheme/a/b", "http://", "x://a.org:80/a", "http://user@org/a", "a://b://c", "http://org\n/a", "http://org/" + "a" * 40_000] + ["http://www.org/a/b"] * 400
    return urls, rules


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_against_every_rule(spark, broadcast):
    urls, rules = random_table(random.Random(broadcast + 3))
    pages = spark.createDataFrame([(i, u, "k", "h", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, `_Host` string, verdict int").repartition(3)
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block"), ("org", "/", None), rules[0]], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, table, broadcast_urls=broadcast).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == judged(u, rules), u
    assert len({v[2] for v in got.values()}) > 30


def test_sweep_over_many_ranges(spark):
    """A rule that holds all keys is on the stack of every range, however the keys are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        urls = [(i, f"http://h{i % 7}.org/{'x' * (i % 50)}/{i}") for i in range(600)] + [(k, "http://one.org/x") for k in range(600, 900)]
        rules = [("org", "", "allow"), ("org", "/x", "block"), ("h3.org", "/xxx", "allow"), ("h3.org", "/xxxxxxxxxx", "block")]
        got = url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), url_rules.rule_table(spark, rules), default="block").collect()
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *judged(u, rules, "block")) for i, u in urls)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert url_rules.judge_urls(empty, url_rules.rule_table(spark, [("org", "/", "block")])).count() == 0
    got = url_rules.judge_urls(some, url_rules.rule_table(spark, [])).collect()
    assert sorted((r.host, r.path, r.rule, r.verdict) for r in got) == [("", "", None, "allow"), ("a.org", "/x", None, "allow"), ("a.org", "/x", None, "allow")]
