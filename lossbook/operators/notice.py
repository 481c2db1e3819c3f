"""Reading a notice: every field that a person scanning it would find, with how sure the reading is and where it was read.

A notice is split into lines once and each line is read once, into its label (of all fields' labels) and value; a field takes the first line with one of its labels. A line
holds at most one label, as a label must be followed by its colon or dash. What no label tells is looked for in the prose: references, dates and amounts by pattern, counts of
people around their words with the negations near them, flags by phrases, the longest paragraph as the description.

Edge cases: null and empty notices have no fields but the flags, which say no; a lone carriage return is part of its line; a value that says nothing (``none``,
``unknown``) is null with its label's confidence; a notice of any length is read whole, evidence and values are cut to their lengths; repeated rows are each read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.functions.parsing import parse_email, parse_phone
from lossbook.vocab import (
    ABSENT_FLAG_CONFIDENCE, COUNT_AFTER_PATTERN, COUNT_BEFORE_PATTERN, EVIDENCE_WIDTH, INFERRED_CONFIDENCE, LABEL_GAP, LABEL_LEAD, LABELLED_CONFIDENCE, MAX_EVIDENCE_LENGTH,
    MAX_VALUE_LENGTH, NEGATION_PATTERN, NEXT_LABEL_PATTERN, NOTHING_VALUES, NOTICE_COUNTS, NOTICE_FLAGS, NOTICE_LABELS, NOTICE_PATTERNS, PARAGRAPH_CONFIDENCE,
    PARAGRAPH_EVIDENCE, SILENT_VALUES,
)

BLANKS = " \t\r\n\x0b\x0c"
FIELDS = tuple(dict.fromkeys([*NOTICE_LABELS, *NOTICE_FLAGS]))
BEFORE, AFTER = 30, 24


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value made once, not once for each place that reads it."""
    return F.get(F.transform(F.array(value), of), 0)


def _read(value: Column, confidence: float, evidence: Column) -> Column:
    """A reading, its value and evidence cut to length; a value that says nothing is null."""
    said = _once(_strip(value), lambda v: F.when(~F.lower(v).isin(*NOTHING_VALUES), F.left(v, F.lit(MAX_VALUE_LENGTH))))
    where = F.nullif(F.left(_strip(evidence), F.lit(MAX_EVIDENCE_LENGTH)), F.lit(""))
    return F.struct(said.alias("value"), F.lit(confidence).alias("confidence"), where.alias("evidence"))


def _nothing() -> Column:
    none = F.lit(None).cast("string")
    return F.struct(none.alias("value"), F.lit(0.0).alias("confidence"), none.alias("evidence"))


def _first(*readings: Column) -> Column:
    """The first reading with a value; those after it are not made."""
    return F.coalesce(*[_once(r, lambda x: F.when(x["value"].isNotNull(), x)) for r in readings], _nothing())


def _around(text: Column, needle: Column) -> Column:
    """What stands around the needle's first place in the text; the needle itself where it isn't there."""
    half = EVIDENCE_WIDTH // 2

    def of(at: Column) -> Column:
        start = F.greatest(at - half, F.lit(1))
        return F.when(at > 0, _strip(F.substring(text, start, at + F.length(needle) + half - start))).otherwise(needle)

    return _once(F.instr(text, needle), of)


def labelled_lines(lines: Column, fields: tuple[str, ...] = tuple(NOTICE_LABELS)) -> Column:
    """array of (at, field, value, r) of the lines with a label of the fields, in order: the field's place in ``NOTICE_LABELS``, the value, null where it says nothing, and its reading.

    A line has at most one label, so each labelled line is read for the one field it is about, and lines without a colon or dash aren't searched.
    """
    field_of = {x: no for no, (field, labels) in enumerate(NOTICE_LABELS.items()) if field in fields for x in labels}
    names = "|".join(re.escape(x) for x in sorted(field_of, key=lambda x: (-len(x), x)))
    start = rf"(?is)^{LABEL_LEAD}({names}){LABEL_GAP}"
    numbers = F.create_map(*[F.lit(x) for pair in field_of.items() for x in pair])

    def mark(line: Column, at: Column) -> Column:
        gap = F.contains(line, F.lit(":")) | F.contains(line, F.lit("-")) | F.contains(line, F.lit("–"))
        return F.struct(at.alias("at"), line.alias("line"), F.when(gap, F.lower(F.regexp_extract(line, f"{start}.", 1))).otherwise("").alias("label"))

    def read(x: Column) -> Column:
        value = _strip(F.regexp_extract(x["line"], rf"{start}(.+?)[ \t]*\z", 2))
        return F.struct(x["at"].alias("at"), F.element_at(numbers, x["label"]).alias("field"), _once(value, lambda v: F.when(~F.lower(v).isin(*SILENT_VALUES), v)).alias("value"), x["line"].alias("line"))

    def judged(x: Column) -> Column:
        reading = F.when(x["value"].isNotNull(), _read(x["value"], LABELLED_CONFIDENCE, x["line"])).otherwise(_nothing())
        return F.struct(x["at"].alias("at"), x["field"].alias("field"), x["value"].alias("value"), reading.alias("r"))

    return F.transform(F.transform(F.filter(F.transform(lines, mark), lambda x: x["label"] != ""), read), judged)


def _line_of(found: Column, about: Column, field: str) -> Column:
    """The first line about a field, null if there is none. about: the fields of found."""
    return F.get(found, (F.array_position(about, F.lit(list(NOTICE_LABELS).index(field))) - 1).cast("int"))


def _continued(found: Column, about: Column, lines: Column, field: str) -> Column:
    """A labelled reading whose value goes on over the lines up to a blank one or the next label."""
    def of(x: Column) -> Column:
        after = F.slice(lines, x["at"] + 2, F.size(lines))
        ends = F.transform(after, lambda y, i: F.when((_strip(y) == "") | y.rlike(NEXT_LABEL_PATTERN), i))
        stop = F.coalesce(F.array_min(ends), F.size(after))
        value = F.array_join(F.concat(F.array(x["value"]), F.transform(F.slice(after, F.lit(1), stop), _strip)), " ")
        return F.when(x["value"].isNotNull(), _read(value, LABELLED_CONFIDENCE, x["r"]["evidence"]))

    return _once(_line_of(found, about, field), of)


def _by_pattern(text: Column, field: str) -> Column:
    return _once(F.regexp_extract(text, f"(?i){NOTICE_PATTERNS[field]}", 0), lambda x: F.when(x != "", _read(x, INFERRED_CONFIDENCE, _around(text, x))))


def _count(text: Column, low: Column, field: str) -> Column:
    """How many people prose speaks of: none where a negation is near, the number beside the word, or one."""
    def at(stem: str) -> Column:
        def of(place: Column) -> Column:
            start = F.greatest(place - BEFORE, F.lit(1))
            near = F.struct(F.substring(low, start, place - start).alias("before"), F.substring(low, place + len(stem), F.lit(AFTER)).alias("after"))
            return F.when(place > 0, _read(_once(near, number), INFERRED_CONFIDENCE, _around(text, F.lit(stem))))

        def number(near: Column) -> Column:
            parts = [F.nullif(F.regexp_extract(near[part], pattern, 1), F.lit("")) for part, pattern in (("before", COUNT_BEFORE_PATTERN), ("after", COUNT_AFTER_PATTERN))]
            return F.when(near["before"].rlike(NEGATION_PATTERN) | near["after"].rlike(NEGATION_PATTERN), "0").otherwise(F.coalesce(*parts, F.lit("1")))

        return _once(F.instr(low, stem), of)

    return F.coalesce(*[at(stem) for stem in NOTICE_COUNTS[field]])


def _flag(text: Column, low: Column, phrases: tuple[str, ...]) -> Column:
    said = F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])
    return _once(said, lambda p: F.when(p.isNotNull(), _read(F.lit("yes"), INFERRED_CONFIDENCE, _around(text, p))).otherwise(_read(F.lit("no"), ABSENT_FLAG_CONFIDENCE, F.lit(None).cast("string"))))


def _paragraph(text: Column) -> Column:
    """The first longest paragraph over 80 letters that doesn't begin with a label."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: (F.length(_strip(p)) > 80) & ~F.contains(F.left(p, F.lit(24)), F.lit(":")))
    best = F.aggregate(F.transform(parts, _strip), F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    return _once(best, lambda p: F.when(p != "", _read(F.left(p, F.lit(MAX_VALUE_LENGTH)), PARAGRAPH_CONFIDENCE, F.left(p, F.lit(PARAGRAPH_EVIDENCE)))))


def read_notices(notices: DataFrame, key: str, text: str, sender: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """key, field, value, confidence, evidence: a row for each of ``fields`` of each notice, present or not.

    What no label has told is looked for in the prose only then, and only the fields asked for are read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    envelope = F.lit(None).cast("string") if sender is None else F.col(sender)
    rows = notices.select(F.col(key).alias("key"), body.alias("body"), envelope.alias("sender"))
    rows = rows.select("*", F.lower("body").alias("low"), F.split("body", "\n", -1).alias("lines"))
    rows = rows.select("*", labelled_lines(F.col("lines"), fields).alias("found")).select("*", F.col("found.field").alias("about"))
    body, low, found, about = F.col("body"), F.col("low"), F.col("found"), F.col("about")
    none = F.lit(None).cast("string")
    inferred = lambda c, where: _once(c, lambda x: F.when(x.isNotNull(), _read(x, INFERRED_CONFIDENCE, where)))
    prose = {field: [_by_pattern(body, field)] for field in NOTICE_PATTERNS} | {field: [_count(body, low, field)] for field in NOTICE_COUNTS}
    prose["loss_description"] = [_paragraph(body)]
    prose["reporter_email"] = [inferred(F.when(F.contains(body, F.lit("@")), parse_email(body)), none), inferred(F.col("sender"), F.lit("message envelope"))]
    prose["reporter_phone"] = [inferred(parse_phone(body), none)]
    readings = {}
    for field in fields:
        if field in NOTICE_FLAGS:
            readings[field] = _flag(body, low, NOTICE_FLAGS[field])
        else:
            told = _line_of(found, about, field)["r"] if field != "loss_description" else _continued(found, about, F.col("lines"), field)
            readings[field] = _first(told, *prose[field]) if field in prose else F.coalesce(told, _nothing())
    table = F.array(*[F.struct(F.lit(field).alias("field"), readings[field].alias("r")) for field in fields])
    return rows.select(F.col("key").alias(key), F.explode(table).alias("f")).select(key, "f.field", "f.r.value", "f.r.confidence", "f.r.evidence")


def overall_confidence(readings: DataFrame, key: str) -> DataFrame:
    """key, overall_confidence: the share of fields with a value, two places."""
    return readings.groupBy(key).agg(F.round(F.count("value") / F.count(F.lit(1)), 2).alias("overall_confidence"))


#: What ``stated_parties`` reads.
PARTY_FIELDS = ("insured_name", "insured_organisation", "reporter_name", "reporter_organisation", "reporter_email", "reporter_phone")


def stated_parties(readings: DataFrame, key: str) -> DataFrame:
    """key, role, name, organisation, email, phone, confidence of the insured and the reporter, where a notice names them."""
    names = PARTY_FIELDS
    told = readings.filter(F.col("field").isin(*names)).groupBy(key).agg(
        *[F.max(F.when(F.col("field") == n, F.struct("value", "confidence"))).alias(n) for n in names]
    )
    none = F.lit(None).cast("string")

    def party(role: Column, name: str, organisation: str, email: Column, phone: Column) -> Column:
        made = F.struct(
            role.alias("role"), F.col(f"{name}.value").alias("name"), F.col(f"{organisation}.value").alias("organisation"), email.alias("email"), phone.alias("phone"),
            F.col(f"{name}.confidence").alias("confidence"),
        )
        return F.when(F.col(f"{name}.value").isNotNull(), made)

    parties = [
        party(F.lit("insured"), "insured_name", "insured_organisation", none, none),
        party(F.when(F.col("reporter_organisation.value").isNotNull(), "broker").otherwise("other"), "reporter_name", "reporter_organisation", F.col("reporter_email.value"), F.col("reporter_phone.value")),
    ]
    return told.select(key, F.inline(F.filter(F.array(*parties), lambda x: x.isNotNull())))
