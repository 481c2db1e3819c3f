"""Typed readings of what people write: dates, money, counts, contacts, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lossbook.vocab import (
    AMOUNT_PATTERN, CLOCK_PATTERN, CURRENCIES, DATE_FORMATS, EMAIL_PATTERN, FALSE_WORDS, LINE_ALIASES, LINES, LOSS_TYPES, MAX_MINOR, MILLION_PATTERN, PARTY_ROLES,
    PHONE_PATTERN, ROLE_ALIASES, THOUSAND_PATTERN, TRUE_WORDS,
)


def parse_date(value: Column) -> Column:
    """A calendar date in one of DATE_FORMATS, a compact ISO date or an ISO timestamp, else null."""
    text = F.regexp_replace(F.replace(F.btrim(value), F.lit(","), F.lit(" ")), r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    text = F.when(text.rlike("[A-Za-z]"), F.initcap(text)).otherwise(text)
    found = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS]
    iso = F.when(F.btrim(value).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.left(F.btrim(value), F.lit(10)).try_cast("date"))
    compact = F.when(F.btrim(value).rlike(r"^\d{8}$"), F.try_to_timestamp(F.btrim(value), F.lit("yyyyMMdd")).cast("date"))
    return F.coalesce(*found, iso, compact)


def parse_datetime(date: Column, time: Column, as_of: Column) -> Column:
    """The loss moment, null outside ten years before and one day after as_of."""
    day = parse_date(date)
    part = [F.coalesce(F.nullif(F.regexp_extract(time, CLOCK_PATTERN, k), F.lit("")).cast("int"), F.lit(0)) for k in (1, 2)]
    stamp = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), part[0], part[1], F.lit(0))
    inside = (stamp <= as_of + F.expr("interval '1' day")) & (stamp >= as_of - F.expr("interval '3650' day"))
    return F.when(inside, stamp)


def parse_money_minor(value: Column) -> Column:
    """Minor units with k and m multipliers; null if absent, negative or above ten thousand million."""
    text = F.lower(F.btrim(value))
    number = F.regexp_extract(text, AMOUNT_PATTERN, 1)
    amount = F.regexp_replace(number, r"[,\s]", "").try_cast("decimal(20,4)")
    times = F.when(text.rlike(MILLION_PATTERN), 1_000_000).when(text.rlike(THOUSAND_PATTERN), 1_000).otherwise(1)
    minor = F.bround(amount * times * 100, 0).cast("long")
    return F.when((minor >= 0) & (minor <= MAX_MINOR), minor)


def parse_currency(value: Column, fallback: str = "GBP") -> Column:
    text, out = F.lower(F.btrim(value)), None
    for symbol, code in CURRENCIES:
        out = F.when(F.contains(text, F.lit(symbol)), code) if out is None else out.when(F.contains(text, F.lit(symbol)), code)
    return out.otherwise(fallback)


def parse_count(value: Column, maximum: int = 100_000) -> Column:
    text = F.lower(F.btrim(value))
    count = F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+", 0), F.lit("")).try_cast("long")
    zero = text.isin(*FALSE_WORDS) | text.startswith("no ")
    return F.when(text == "", None).when(zero, F.lit(0).cast("long")).when(count.between(0, maximum), count)


def parse_bool(value: Column) -> Column:
    text = F.lower(F.btrim(value))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def parse_email(value: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(value, EMAIL_PATTERN, 0)), F.lit(""))


def parse_phone(value: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(value, PHONE_PATTERN, 0), r"[^\d+]", "")
    return F.when(F.length(F.ltrim(digits, F.lit("+"))).between(7, 15), digits)


def _key(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(value)), "[^a-z]+", "_"), F.lit("_"))


def _mapped(key: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def parse_line_of_business(value: Column) -> Column:
    """A line on the books, else null; nothing new is made up."""
    key = _key(value)
    return F.coalesce(_mapped(key, LINE_ALIASES), F.when(key.isin(*LINES, "unknown"), key))


def parse_party_role(value: Column) -> Column:
    key = _key(value)
    key = F.coalesce(_mapped(key, ROLE_ALIASES), key)
    return F.when(key.isin(*PARTY_ROLES), key).otherwise("other")


def valid_loss_type(line: Column, loss_type: Column) -> Column:
    """The loss type if the line offers it, else null."""
    known = F.create_map(*[x for k, v in LOSS_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    key = F.translate(F.lower(F.btrim(loss_type)), " -", "__")
    return F.when(F.array_contains(F.element_at(known, line), key), key)
