"""The ten operators against brute force, and over awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from helpers import WORD, jaccard_groups, sentence, shingles, words_of
from pyspark.sql import functions as F

from lossbook.llm import (
    decontaminate, fixity, html_blocks, line_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, substring_dedup, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, h string, bucket int, token string"


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): copies, near copies, shared passages, and awkward rows."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    passage = sentence(rng, 60)
    out: list[tuple[int | None, str | None, str | None]] = [(i, sentence(rng, rng.randrange(20, 200)), f"s{i % 3}") for i in range(30)]
    out += [(100 + i, base, "s0") for i in range(4)]
    for i in range(6):
        words = base.split()
        for _ in range(i * 2):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append((110 + i, " ".join(words), "s1"))
    out += [(120 + i, sentence(rng, 80) + " " + passage + " " + sentence(rng, 40), "s2") for i in range(4)]
    out += [(130, (sentence(rng, 40) + " ") * 2, None), (131, None, "s1"), (132, "", "s1"), (133, " \n\t ", None), (134, "one two three", "s0"), (135, "One  two\nTHREE", "s0")]
    out += [(136, "É" * 50 + " " + "x" * 5000, "s2"), (137, sentence(rng, 30_000), "s2"), (None, sentence(rng, 50), "s0"), (100, base, "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en", s, None if t is None else len(t), "k", 1, "h", 2, "t") for d, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(docs, texts, none):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r) for r in quality_rules.clean_lines(docs).collect())
    want = sorted(((d if d is not None else -1), t or "") for d, t, _ in texts)
    assert len(got) == len(want)
    for (_, r), (_, text) in zip(got, want, strict=True):
        words = words_of(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        )
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.clean_lines(none).count() == 0


def test_quality_lines(spark):
    good = "This is a plain sentence that says something about a thing and ends well.\n" * 1 + "Another plain sentence follows it with other words and also ends well."
    junk = "Home | News | Sport | Weather | Contact | About\nACCEPT COOKIES AND READ THE COOKIE POLICY\nbuy### now*** cheap$$$ deal%%% now&&&"
    rows = [(1, good), (2, junk + "\n" + junk.lower()), (3, good + "\n" + "Please accept cookies here."), (4, good + "\n\n" + "menu | home | login | help")]
    got = {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4)] == [True, False, True, True]
    assert got[1].clean_text == good and got[3].clean_text == good and got[4].clean_text == good + "\n"


def failed_line(line: str) -> bool:
    """The line rules one line at a time."""
    words = WORD.findall(line)
    if not words:
        return False
    n, size = len(words), sum(len(w.encode()) for w in words)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    latin = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
    folded = "".join(c.lower() if c.isascii() or c in latin else c for c in line)
    capitals = len(re.findall("[A-Z]", line)) + 2 * sum(c in latin for c in line)
    return (
        any(p in folded for p in quality_rules.BOILERPLATE) or len(re.findall(r"[#*$%&|<>]", line)) > 0.5 * n or line.count("|") > 0.2 * n
        or (n >= 4 and (capitals > 0.5 * size or twice > 0.4 * n)) or (n < 12 and line.rstrip(" \t\r\x0b\x0c")[-1] not in quality_rules.ENDS)
    )


def test_quality_verdicts_by_brute_force(spark, docs, texts):
    """Every row alone gives the verdict, whatever stands beside it in a batch."""
    rng = random.Random(31)
    more = [f"{sentence(rng, 20)} and about our privacy ", f"policy {sentence(rng, 30)}", f"{sentence(rng, 20)}\nAlle Rechte vorbehalten {sentence(rng, 12)}", "ALL CAPS HERE NOW.\n" + sentence(rng, 30), f"{sentence(rng, 25)}\nTOUS DROITS RÉSERVÉS.\nTous droits réservés.", f"{sentence(rng, 25)}\nMit freundlichem Gruß\nMit Gruß.\nc'est dû\n„So“\n“so”\nÉTÉ ÀÉÈ ÊÔ ÛÎ\nvoilà…\n好的。\nÙ", "very very very very much\n\nx" * 9]
    rows = [*[t for _, t, _ in texts], *more]
    frame = spark.createDataFrame([(i, t, "k", 3, True) for i, t in enumerate(rows)], "doc_id long, text string, n_words string, kept int, clean_text boolean").coalesce(1)
    got = {r.doc_id: r for r in quality_rules.clean_lines(frame, carry=("doc_id", "n_words")).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        lines = (text or "").split("\n")
        bad = [x for x in lines if failed_line(x)]
        lost, n = sum(len(WORD.findall(x)) for x in bad), len(words_of(text))
        assert (got[i].n_lost_words, got[i].n_failed_lines, got[i].n_words) == (lost, len(bad), n)
        assert got[i].kept == (not got[i].base_failed and 100 * lost <= 50 * n)
        assert got[i].clean_text == ((text or "") if not bad else "\n".join(x for x in lines if not failed_line(x)))


def test_documents_with_one_hash_are_told_apart(spark, monkeypatch):
    """Documents whose 64-bit identity is the same by chance keep their own windows."""
    rng = random.Random(40)
    rows = [(i, sentence(rng, 60 + i)) for i in range(6)]
    real = substring_dedup.F.xxhash64
    monkeypatch.setattr(substring_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if isinstance(c[0], str) and c[0] == "id" else real(*c))
    got = substring_dedup.told_apart(spark.createDataFrame(rows, "id long, text string")).collect()
    assert len({r.key for r in got}) == 6 and sorted((r.id, r.text) for r in got) == rows


def test_substring_brute_force(docs, texts, none):
    counts = Counter(tuple(w[i : i + 35]) for _, t, _ in texts for w in [words_of(t)] for i in range(len(w) - 34))
    want = Counter()
    for d, t, _ in texts:
        words, gone = words_of(t), set()
        for i in range(len(words) - 34):
            if counts[tuple(words[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[(d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_jaccard_brute_force(docs, texts, none):
    want = jaccard_groups(texts)
    rows = ngram_jaccard.jaccard_components(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_jaccard_without_broadcasts(docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_PAIRS", 0)
    got = ngram_jaccard.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == jaccard_groups(texts)


def test_bitmap_keeps_every_id_that_is_there(spark):
    rows = spark.range(-300, 3000).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    ids = spark.range(-200, 200).select((F.col("id") * 7).alias("wanted"))
    got = {r.id for r in ngram_jaccard._likely(rows, ids).collect()}
    want = {7 * k for k in range(-200, 200) if -300 <= 7 * k < 3000}
    assert want <= got and len(got - want) < 20
    assert ngram_jaccard._likely(rows, ids.limit(0)).count() == 0


def test_near_copies_that_mostly_do_not_link(spark):
    """One group of near copies without its original: few pairs reach the threshold, and none of those may be lost."""
    rng = random.Random(8)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.randrange(2, 10)):
            words[rng.randrange(150)] = f"edit{rng.randrange(10**7)}"
        rows.append((i, " ".join(words + [f"tail{rng.randrange(10**7)}"] * rng.randrange(3)), None))
    rows += [(500, rows[0][1].upper(), None), (501, rows[3][1] + " one more", None), (502, sentence(rng, 200_000), None)]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows)


def test_rows_with_one_doc_id_and_clashing_columns(spark):
    """Rows that share a doc_id are one node that links where any of its texts does."""
    rng = random.Random(12)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (3, a + " more"), (4, b), (9, c)]
    columns = ("id", "n", "class", "centre", "prefix", "label", "node", "component")
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit("x").alias(c) for c in columns])
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in ngram_jaccard.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_line_dedup(spark, docs, none):
    rows = [(i, f"line {i}\n  shared footer \nother {i % 2}", "a") for i in range(40)] + [(50, "shared footer", "b"), (51, None, "a"), (52, "", None)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == "line 0" and (got[0].n_lines, got[0].n_dropped) == (3, 2)
    assert got[50].text == "shared footer" and got[51].text is None and got[52].text == ""
    few = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_lines=0)
    assert {r.doc_id: r.text for r in few.collect()} == {k: r.text for k, r in got.items()}
    named = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _drop", "2 AS _DROP_", "3 AS _kept", "4 AS _host", "5 AS keys")
    again = line_dedup.drop_boilerplate(named).collect()
    assert {r.doc_id: r.text for r in again} == {k: r.text for k, r in got.items()} and {(r["_drop"], r["_DROP_"], r["_kept"], r["_host"], r["keys"]) for r in again} == {(1, 2, 3, 4, 5)}
    assert line_dedup.drop_boilerplate(docs).count() == docs.count() and line_dedup.drop_boilerplate(none).count() == 0


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(5000)] + [(5000, None, None), (None, "u", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    other = pages.filter("page_id <> 17").withColumn("html", F.when(F.col("page_id").isin(3, 4500), "bad").otherwise(F.col("html")))
    other = other.unionByName(spark.createDataFrame([(6000, "u", "new")], pages.schema))
    got = {(r.number, r.kind) for r in fixity.audit(fixity.warc_records(pages), fixity.warc_records(other)).collect()}
    assert got == {(17, "missing"), (3, "altered"), (4500, "altered"), (6000, "extra"), (fixity.NO_NUMBER, "missing")}
    assert fixity.audit(fixity.warc_records(pages), fixity.warc_records(pages)).count() == 0
    records = fixity.leaves(fixity.warc_records(pages)).orderBy("archive", "number").collect()
    assert all(b.offset == a.offset + a.length for a, b in zip(records, records[1:], strict=False) if a.archive == b.archive)
    lost = pages.filter("page_id is not null").withColumn("digest", F.lit("x")).withColumn("archive", F.lit(1))
    assert [(r.number, r.kind) for r in fixity.audit(fixity.warc_records(pages), fixity.warc_records(lost)).collect()] == [(fixity.NO_NUMBER, "missing")]
    many = pages.unionByName(spark.createDataFrame([(7, "u", "h" * 1_000_000), (7, "u", "other"), (7, "u", "other")], pages.schema))
    fewer = pages.unionByName(spark.createDataFrame([(7, "u", "other"), (7, "u", "h" * 1_000_000)], pages.schema))
    assert fixity.audit(fixity.warc_records(many), fixity.warc_records(many.repartition(3))).count() == 0
    assert [(r.number, r.kind) for r in fixity.audit(fixity.warc_records(many), fixity.warc_records(fewer)).collect()] == [(7, "altered")]
    assert fixity.audit(fixity.warc_records(pages.limit(0)), fixity.warc_records(pages.limit(0))).count() == 0


def test_warc_record(spark):
    head, _, block = spark.range(1).select(fixity.warc_record(F.lit("http://x/"), F.lit("<p>é</p>"))).first()[0].partition("\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
    assert head.startswith("WARC/1.1\r\n") and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"]) and "WARC-Date" in fields
    assert block.endswith("\r\n\r\n") and len(block[:-4].encode()) == int(fields["Content-Length"]) and block.startswith("HTTP/1.1 200 OK\r\n")


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href="/a">Home</a> <a href="/b">News</a></nav>
    <div class="ad">Buy this thing now and save.</div><article><h1>Head&amp;line</h1><p>First   paragraph <b>bold</b>
    text.<p>Second one<script>var x = "<p>no</p>";</script>.</p><div class="comments"><p>I disagree with all of it.</p></div></article>
    <aside>Related things to read</aside><form>Name <input></form><footer>&copy; nobody</footer></body></html>"""
    got = html_blocks.main_texts([page, None, "", "<p>", "<!-- only -->", page.replace("</article>", "")])
    assert got[0] == "Head&line\n\nFirst paragraph bold text.\n\nSecond one\n\n."or got[0].startswith("Head&line\n\nFirst paragraph bold text.\n\nSecond one")
    assert "disagree" not in got[0] and "nobody" not in got[0] and "Buy" not in got[0]
    assert got[1:5] == ["", "", "", ""]


@pytest.mark.parametrize(
    "outer, inner",
    [
        ("<body class='home has-sidebar'>", "<article>"), ("<body><div class='content with-sidebar'>", "<div>"), ("<body>", "<article class='post comments-open share'>"),
        ("<body class='modal'><div class='comments-area sidebar'>", "<article>"), ("<body><div class='widget'>", "<main class='menu'>"), ("<body id='login'>", "<main><article class='ad'>"),
    ],
)
def test_html_names_of_pages_and_articles(outer, inner):
    """Names of body, main, article and layout wrappers don't make the article furniture; containers named so still do."""
    text = "The council met on Monday and agreed to repair the old bridge over the river before winter comes."
    foot = "<div class='comments'><article class='comment'><p>I disagree with all of what was said here.</p></article></div>"
    page = f"<html>{outer}{inner}<h1>The bridge</h1><p>{text}</p><p>{text}</p>{foot}</article></main></div>{foot}<aside><p>Related things to read</p></aside></body></html>"
    assert html_blocks.main_texts([page]) == [f"The bridge\n\n{text}\n\n{text}"]
    assert html_blocks.main_texts([f"<body><div class='sidebar'><p>{text}</p></div><article hidden><p>{text}</p></article></body>"]) == [""]


TEXT = "The council met on Monday and agreed to repair the old bridge over the river before winter comes."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{TEXT}</p><svg/><p>{TEXT}</p><iframe src=x><p>{TEXT}</p></article>", [TEXT] * 3),
        (f"<article><svg><text>no</text></svg><p>{TEXT}</p><object><p>{TEXT}</p></article>", [TEXT] * 2),
        (f"<article><p><a href=x>Read</p><p>{TEXT}</p><p>{TEXT}</p></article>", [TEXT] * 2),
        (f"<article><div><a href=x>Read</div><p>{TEXT}</p></article><p><a href=y>Other</a></p>", [TEXT]),
        (f"<article><p title=don't>{TEXT}</p><p title='a > b'>{TEXT}</p></article>", [TEXT] * 2),
        ("<p>One two three.</p><p>Four five six.</p><p>Seven eight.</p>", ["One two three.", "Four five six.", "Seven eight."]),
        (f"<head><title>T</title><body><p>{TEXT}</p>", [TEXT]),
        (f"<article><p>1 &lt; 2 &nosuch; &#xE9;&amp;lt;</p><p>{TEXT}</p></article><script>var a = '<p>no</p>'", ["1 < 2 &nosuch; é&lt;", TEXT]),
        (f"<body><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div>Buy it now.</div><h1>The bridge</h1><p>{TEXT}</p><p>{TEXT}</p><footer>Nobody</footer>", ["The bridge", TEXT, TEXT]),
        ("<article>" + f"<p>{TEXT}</p>" * 20_000 + "</article>", [TEXT] * 20_000),
    ],
)
def test_html_pages_by_hand(page, want):
    assert html_blocks.main_texts([page]) == ["\n\n".join(want)]


def test_html_counts_and_neighbours_decide_without_names():
    """Pages whose parts have no names: the menu, the advert after it and the footer go by densities and neighbours."""
    rng = random.Random(70)
    pages, want = [], []
    for _ in range(200):
        body = [sentence(rng, rng.randrange(3, 12)), *[sentence(rng, rng.randrange(6, 60)) for _ in range(rng.randrange(2, 9))]]
        menu = "".join(f"<div><a href='/{k}'>{sentence(rng, 1)}</a></div>" for k in range(rng.randrange(3, 9)))
        pages.append(f"<body>{menu}<div>{sentence(rng, rng.randrange(3, 10))}</div><h1>{body[0]}</h1>" + "".join(f"<div>{b}</div>" for b in body[1:]) + "<footer>c</footer>")
        want.append("\n\n".join(body))
    right = sum(a == b for a, b in zip(html_blocks.main_texts(pages), want, strict=True))
    assert right >= 0.95 * len(pages)


def test_html_query(spark):
    rows = [(1, "u", "<article><p>Some text here.</p></article>"), (2, None, None), (1, "u", "<article><p>Some text here.</p></article>"), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS _html")
    got = html_blocks.extract_text(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter([(1, "Some text here.", 15), (2, "", 0), (1, "Some text here.", 15), (None, "", 0)])
    assert html_blocks.extract_text(pages.limit(0)).count() == 0


def test_leaks(spark, docs, none):
    rng = random.Random(9)
    items = [(i, sentence(rng, 25) + "\n" + sentence(rng, 8)) for i in range(30)] + [(50, ""), (51, None), (52, "tiny item")]
    plain = [(i, sentence(rng, 150)) for i in range(40)]
    holding = [(100 + i, sentence(rng, 70) + " " + t.upper().replace("\n", " ") + "### " + sentence(rng, 70)) for i, t in items[:30]]
    rows = spark.createDataFrame(plain + holding + [(300, None), (301, ""), (302, items[3][1].split("\n")[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + i, i) for i, _ in items[:30]}
    for leak in (decontaminate.Leak(), decontaminate.Leak(items_per_block=7)):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench, leak).collect()}
        assert got == want
    assert decontaminate.drop_leaks(rows, bench).count() == rows.count() - 30
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(rows, bench.limit(0)).count() == 0


def test_leaks_of_awkward_rows(spark):
    """Null and repeated item ids are items of their own; null and repeated doc_ids are judged row by row; one very long text; clashing names."""
    rng = random.Random(61)
    items = [(None, sentence(rng, 20)), (1, sentence(rng, 20)), (1, sentence(rng, 20)), (1, None), (2, sentence(rng, 20)), (2, None)]
    items += [items[4], (9, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h", "2 AS n_terms", "3 AS doc_id")
    held = [sentence(rng, 40) + " " + t + " " + sentence(rng, 40) for _, t in items[:3]] + [sentence(rng, 150_000) + " " + items[4][1] + " " + sentence(rng, 90_000)]
    rows = [(None, held[0]), (None, sentence(rng, 80)), (5, held[1]), (5, held[2]), (5, sentence(rng, 80)), (6, held[3]), (6, held[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score", "3 AS row", "4 AS key")
    want = Counter([(None, None), (5, 1), (5, 1), (6, 2), (6, 9), (6, 2), (6, 9)])
    for leak in (decontaminate.Leak(), decontaminate.Leak(items_per_block=2)):
        assert Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, leak).collect()) == want
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([rows[1], rows[4]])


def test_scores_of_edited_copies_for_any_block_size(spark):
    rng = random.Random(21)
    items = [(i, " ".join(rng.choice(["common", "usual", "often"]) if rng.random() < 0.3 else w for w in sentence(rng, 12 + i).split()) + "\n" + sentence(rng, 8)) for i in range(23)]
    rows = []
    for i, text in items:
        for edits in range(12):
            words = text.replace("\n", " ").split()
            for at in rng.sample(range(len(words) - 8), edits):
                words[at] = f"edit{rng.randrange(10**6)}"
            rows.append((100 * i + edits, sentence(rng, 60) + " " + " ".join(words) + " " + sentence(rng, 60)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.leaks(docs, bench).collect()}
    assert {s[0] < 0.99 for s in whole.values()} == {True, False} and len(whole) < len(rows)
    for size in (1, 5, 22):
        got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.leaks(docs, bench, decontaminate.Leak(items_per_block=size)).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in got)


def test_wand_equals_brute_force():
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randrange(5, 40))) for i in range(60)]
    leak = decontaminate.Leak(threshold=0.2, block=4)
    index = decontaminate.build_index(items, leak)
    import numpy as np

    queries = [sorted(rng.sample(range(len(index.terms)), 40)) for _ in range(50)] + [index_terms(index, k) for k in range(20)]
    passage = np.concatenate([np.full(len(q), n) for n, q in enumerate(queries)])
    got = {(int(p), int(i)) for p, i, _ in zip(*decontaminate.block_max_wand(index, passage, np.concatenate([np.array(q) for q in queries]), 0.2), strict=True)}
    owner = np.repeat(np.arange(len(index.terms)), [index.posting_first[index.block_first[t + 1]] - index.posting_first[index.block_first[t]] for t in range(len(index.terms))])
    want = set()
    for n, q in enumerate(queries):
        score = Counter()
        for at in np.flatnonzero(np.isin(owner, q)):
            score[int(index.items[at])] += float(index.impacts[at])
        want |= {(n, k) for k, s in score.items() if s >= 0.2 - 1e-9}
    assert got == want


def index_terms(index, item: int) -> list[int]:
    import numpy as np

    at = np.flatnonzero(index.items == item)
    first = index.posting_first[index.block_first[:-1]]
    return sorted({int(np.searchsorted(first, a, side="right") - 1) for a in at})


def test_mix(spark, docs, texts, none):
    got = mixing.mix_sources(docs).collect()
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    assert sum(r.size for r in got) == sum(sizes.values()) and all(r.source_size == sizes[r.source] for r in got)
    targets = {r.source: r.target for r in got}
    assert all(t <= 2 * sizes[s] + 1e-6 for s, t in targets.items())
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-3
    for s, target in targets.items():
        taken, most = sum(r.taken for r in got if r.source == s), max(r.size for r in got if r.source == s)
        assert abs(taken - target) <= most
    assert all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(none).count() == 0
    assert all(r.epochs == 0 for r in got if r.target == 0)


def test_mix_of_empty_sources_and_null_ids(spark):
    rng = random.Random(6)
    rows = [(i, "", "empty") for i in range(5)] + [(None, sentence(rng, 20), "a") for _ in range(300)] + [(7, sentence(rng, 10), None) for _ in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS draw", "3 AS bin", "4 AS target", "5 AS extra")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and {(r.target, r.epochs, r.taken) for r in got if r.source == "empty"} == {(0.0, 0, 0)}
    for source in ("a", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        toxic, junk = i % 5 == 0, i % 4 == 1
        words = sentence(rng, 60).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum", "snarfle", "snarfling"])
        if junk:
            words = [w + rng.choice(["###", "***", "$$$"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "nobody here")]
    labels += [(2000, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label", [(toxicity.score_toxicity, "toxic"), (quality_classifier.score_quality, "quality")])
def test_classifiers_on_held_out_rows(labelled, score, label):
    docs, labels = labelled
    got = score(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels.filter("doc_id is not null"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r[label] for r in rows if r[label] is not None)
    assert len(rows) > 80 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert score(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in score(docs.limit(5), labels.limit(0)).collect()} == {0}


def test_label_model_by_brute_force(spark):
    """The label model over counted patterns equals expectation maximisation document by document, and finds the class without a label."""
    rng, voters, rounds = random.Random(17), 7, 6
    truth = [rng.random() < 0.2 for _ in range(600)]
    votes = []
    for t in truth:
        row = [0 if rng.random() < 0.2 else (1 if t == (rng.random() < 0.85) else -1) for _ in range(voters - 1)]
        votes.append([*row, row[-1]])  # the last two voters say the same
    rows = spark.createDataFrame([(bytes(v % 256 for v in row),) for row in votes], "votes binary")
    model = toxicity.fit_label_model(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), rounds)

    chance, prior, weight = None, None, [1.0] * voters
    post = [1 / (1 + math.exp(1 - sum(row))) for row in votes]
    for r in range(rounds):
        if r:
            post = []
            for row in votes:
                z = math.log(prior / (1 - prior)) + sum(w * math.log(chance[1][j][x] / chance[0][j][x]) for j, (x, w) in enumerate(zip(row, weight, strict=True)))
                post.append(1 / (1 + math.exp(-z)))
        sides = [[1 - p for p in post], post]
        prior = sum(post) / len(post)
        chance = [[{k: (sum(q for q, row in zip(side, votes, strict=True) if row[j] == k) + 1) / (sum(side) + 3) for k in (-1, 0, 1)} for j in range(voters)] for side in sides]
        inside = [[0.0] * voters for _ in range(voters)]
        for side in sides:
            mean = [sum(q * row[j] for q, row in zip(side, votes, strict=True)) / sum(side) for j in range(voters)]
            for i in range(voters):
                for j in range(voters):
                    inside[i][j] += sum(q * (row[i] - mean[i]) * (row[j] - mean[j]) for q, row in zip(side, votes, strict=True))
        weight = [1 / sum(x for j in range(voters) if (x := 1.0 if i == j else abs(inside[i][j]) / math.sqrt(inside[i][i] * inside[j][j])) > 0.2) for i in range(voters)]
    assert model.prior == pytest.approx(prior, abs=1e-6) and list(model.weight) == pytest.approx(weight, abs=1e-6)
    assert all(model.chance[y][j][k + 1] == pytest.approx(chance[y][j][k], abs=1e-6) for y in (0, 1) for j in range(voters) for k in (-1, 0, 1))
    assert model.weight[-1] < 0.6 and abs(model.prior - 0.2) < 0.05
    import numpy as np

    assert sum((p >= 0.5) == t for p, t in zip(model.posterior(np.array(votes)), truth, strict=True)) > 0.95 * len(truth)


def test_toxicity_of_awkward_rows(labelled, spark):
    """Repeated keys and rows, clashing names and one very long text; rows with one text score alike."""
    docs, labels = labelled
    rng = random.Random(50)
    more = spark.createDataFrame([(5, "idiot moron scum " + sentence(rng, 50)), (3000, sentence(rng, 100_000)), (3001, "a snarfle idiot moron"), (3001, "a snarfle idiot moron")], docs.schema)
    wide = docs.unionByName(more).selectExpr("*", "1 AS key", "2 AS votes", "3 AS x", "4 AS draw", "5 AS score", "6 AS y")
    got = toxicity.score_toxicity(wide, labels.withColumn("text", F.lit("x"))).collect()
    assert len(got) == docs.count() + 4
    assert len({r.score for r in got if r.doc_id == 3001}) == 1 and {r.predicted for r in got if r.doc_id == 3001} == {1}
    assert {r.predicted for r in got if r.doc_id in (3000, 1000, 1001)} == {0}


def test_toxicity_where_posteriors_lie_on_one_side(spark):
    """Two marker words in a third of short documents, documents all alike, and labels of nothing that shows: scores, no crash."""
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(28)) + (" zork blargh" if i % 3 == 0 else " some words")) for i in range(120)]
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    kinds = ("doc_id long, text string", "doc_id long, toxic int")
    alike = [(i, "the same words in every text") for i in range(120)]
    marked = [(i, "zork blargh " * 9) for i in range(60)] + [(i, "zork") for i in range(60, 120)]
    for texts in (rows, alike, marked, [(i, None) for i in range(120)]):
        got = toxicity.score_toxicity(spark.createDataFrame(texts, kinds[0]), spark.createDataFrame(labels, kinds[1])).collect()
        assert len(got) == 120 and all(0 <= r.score <= 1 for r in got)


def test_jaccard_pairs_across_components_have_near_signatures(spark):
    """Documents with one common passage and words of their own meet at its tokens; only pairs near the threshold leave the join, and no linked one is lost."""
    rng = random.Random(11)
    passage = sentence(rng, 70)
    rows = [(k, f"{passage} {sentence(rng, 20)}") for k in range(60)]
    rows += [(100 + k, text.rsplit(" ", 1)[0] + f" other{k}") for k, text in rows[:20]] + [(200, rows[0][1] + " a b"), (200, rows[1][1] + " c d")]
    docs = spark.createDataFrame(rows, "id long, text string")
    described = ngram_jaccard._described(docs, spark.sparkContext.broadcast(ngram_jaccard.frequency_sketch(docs)))
    sizes = described.groupBy(F.col("id").alias("class")).agg(F.when(F.min("n") == F.max("n"), F.max("n")).cast("int").alias("n"))
    members = sizes.select(F.lit(1).alias("token"), "class", F.col("class").alias("component"), "n", F.lit(0).alias("place"))
    got = {(r["class"], r.centre) for r in ngram_jaccard._across(members, described).collect()}
    sets = {(d, i): shingles(t) for i, (d, t) in enumerate(rows)}
    linked = {(max(a, b), min(a, b)) for (a, i), x in sets.items() for (b, j), y in sets.items() if a != b and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(linked) >= 20 and linked <= got
    assert len({p for p in got if 200 not in p}) < 60
