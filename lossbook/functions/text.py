"""Text expressions: normal forms, tokens, clipping. Column in, Column out; null reads as empty where the rules say so."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lossbook.vocab import COMPANY_SUFFIXES, STOPWORDS

_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(p := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and p != c]
_ACCENTED = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370)))
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)
_LIGATURES = {c: unicodedata.normalize("NFKD", c) for c in map(chr, range(0xFB00, 0xFB05))}


def normalise(value: Column) -> Column:
    """Trimmed, lower case, without the accents of Latin letters and with ligatures taken apart, white space as one space; null becomes ''.

    Letters that have no decomposition, as ø and ł, stay.
    """
    folded = F.translate(F.lower(F.coalesce(value, F.lit(""))), _ACCENTED, _PLAIN)
    for ligature, letters in _LIGATURES.items():
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    return F.btrim(F.regexp_replace(folded, r"\s+", " "))


def words(value: Column) -> Column:
    return F.regexp_extract_all(normalise(value), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(value: Column, drop_stopwords: bool = True) -> Column:
    """Distinct words; without stopwords and single letters unless asked for all."""
    found = F.array_distinct(words(value))
    if not drop_stopwords:
        return found
    return F.array_except(F.filter(found, lambda w: F.length(w) > 1), F.array(*map(F.lit, STOPWORDS)))


def normalise_reference(value: Column) -> Column:
    return F.regexp_replace(normalise(value), "[^a-z0-9]", "")


def sql_normal_form(value: Column) -> Column:
    """The stored form of a policy number: lower case letters and digits, accents dropped with their letters."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def normalise_organisation(value: Column) -> Column:
    """A name without its trailing company forms."""
    suffix = "|".join(COMPANY_SUFFIXES)
    return F.regexp_replace(F.array_join(words(value), " "), f"(^| )({suffix})( ({suffix}))*$", "")


def clip(value: Column, size: int) -> Column:
    return F.nullif(F.left(F.btrim(value, F.lit(" \t\r\n")), F.lit(size)), F.lit(""))


def first_distinctive_word(value: Column) -> Column:
    """The first word of more than two letters, else the whole trimmed value."""
    trimmed = F.btrim(value)
    return F.coalesce(F.get(F.filter(F.split(trimmed, r"\s+"), lambda w: F.length(w) > 2), 0), trimmed)


def contains_any(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def title_case(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def reference(prefix: str, year: Column, number: Column) -> Column:
    return F.format_string(f"{prefix}-%04d-%06d", year, number)


def parse_reference(value: Column) -> Column:
    """prefix, year, number of a well-formed reference, else null."""
    pattern = r"^([A-Z]{2,6})-(\d{4})-(\d{4,8})$"
    text = F.upper(F.btrim(value))
    part = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
    return F.when(text.rlike(pattern), F.struct(part[0].alias("prefix"), part[1].cast("int").alias("year"), part[2].cast("int").alias("number")))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and frames go with their contents, other tags leave their text."""
    text = html
    for tag in ("script", "style", "iframe", "object", "embed"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"\s+", " "))


def clean_text(value: Column, size: int = 40_000) -> Column:
    """Blanks as one space, at most one empty line in a row, trimmed and cut to size."""
    text = F.regexp_replace(F.regexp_replace(value, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.left(F.btrim(text, F.lit(" \t\r\n")), F.lit(size))


def organisation_from_email(email: Column) -> Column:
    """An organisation guessed from the first label of a domain that isn't a public mail host."""
    from lossbook.vocab import GENERIC_HOSTS

    label = F.lower(F.get(F.split(F.get(F.split(email, "@"), 1), r"\."), 0))
    good = label.isNotNull() & ~label.isin(*GENERIC_HOSTS) & (F.length(label) >= 3)
    return F.when(good, F.initcap(F.replace(label, F.lit("-"), F.lit(" "))))
