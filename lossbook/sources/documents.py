"""Attachments and notices as text: readers by content type, labelled fields, paragraphs.

Readers of container formats (JSON of any depth, DOCX, XLSX) run as Arrow-batched helpers; everything else is a column expression.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.session import ship

EMPTY_VALUES = ("", "n/a", "tbc", "unknown", "-")


def labelled(text: Column, labels: Iterable[str]) -> Column:
    """The value of the first line ``label: value`` (or with a dash), null if there is none or it says nothing."""
    names = "|".join(re.escape(x) for x in labels)
    found = F.regexp_extract(text, rf"(?im)^[ \t>*\-•]*(?:{names})[ \t]*[:\-–][ \t]*(.+?)[ \t]*$", 1)
    return F.when(~F.lower(found).isin(*EMPTY_VALUES), found)


def longest_paragraph(text: Column, least: int = 80, size: int = 2000) -> Column:
    """The first longest paragraph over ``least`` letters that doesn't begin with a label."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    good = F.filter(parts, lambda p: (F.length(p) > least) & ~F.contains(F.left(p, F.lit(24)), F.lit(":")))
    best = F.aggregate(good, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    return F.nullif(F.left(best, F.lit(size)), F.lit(""))


def flat_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, text: one-level objects as ``name: value`` lines in name order, by map functions only."""
    pairs = F.map_entries(F.from_json(column, "map<string,string>"))
    lines = F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.select(key, F.array_join(lines, "\n").alias("text"))


def csv_row_text(header: str, line: Column) -> Column:
    """A row with its header repeated: ``H: v; H: v``; blank values are left out."""
    names = header.split(",")
    values = F.from_csv(line, ", ".join(f"`{n}` string" for n in names))
    return F.concat_ws("; ", *[F.when(F.btrim(values[n]) != "", F.concat(F.lit(f"{n}: "), values[n])) for n in names])


def _json_lines(value, path: str = "") -> list[str]:
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in _json_lines(v, f"{path} {k}".strip())]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in _json_lines(v, f"{path}[{i}]")]
    return [] if value is None else [f"{path}: {value}"]


def read_json(content: bytes) -> str:
    return "\n".join(_json_lines(json.loads(content.decode("utf-8-sig"))))


def read_office(content: bytes) -> str:
    """Text nodes of a zipped office document, a line for each paragraph or row; at most 20 parts are read."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if re.match(r"(word/[^/]+|xl/sharedStrings|xl/worksheets/[^/]+)\.xml$", n)]
        for name in names[:20]:
            for part in ElementTree.fromstring(archive.read(name)).iter():
                tag = part.tag.rpartition("}")[2]
                if tag in ("p", "row", "si"):
                    out.append("\n")
                if tag in ("t", "v") and part.text:
                    out.append(part.text + ("" if tag == "t" else " "))
    return re.sub(r"\n\s*", "\n", "".join(out)).strip()


def read_csv(content: bytes) -> str:
    """A line for each row with its header repeated: ``H: v; H: v``; blank values are left out."""
    rows = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace")))
    lines = ["; ".join(f"{k}: {v}" for k, v in row.items() if isinstance(k, str) and isinstance(v, str) and v.strip()) for row in rows]
    return "\n".join(line for line in lines if line)


READERS: dict[str, Callable[[bytes], str]] = {
    "application/json": read_json,
    "text/csv": read_csv,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": read_office,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": read_office,
}


def register_reader(content_type: str, reader: Callable[[bytes], str]) -> None:
    READERS[content_type] = reader


def read_attachments(files: DataFrame, size: int = 40_000) -> DataFrame:
    """files: filename, content_type, content -> with text, status (extracted, unsupported, failed), reason, checksum and kind.

    A file of a kind that nothing reads, or without text, is unsupported and says why; content that is null has failed.
    """
    ship(files.sparkSession)
    readers = dict(READERS)

    @F.pandas_udf("struct<text:string,status:string,reason:string>")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, content in zip(kinds, contents, strict=True):
            try:
                if kind in readers:
                    text = readers[kind](content)
                elif (kind or "").startswith("text/") or kind == "message/rfc822":
                    text = content.decode("utf-8", "replace")
                else:
                    rows.append((None, "unsupported", f"no reader for {kind or 'an unknown kind'}"))
                    continue
                rows.append((text, "extracted", None) if text.strip() else (None, "unsupported", "no text"))
            except Exception as error:  # a file that can't be read is a result, not a failure of the job
                rows.append((None, "failed", type(error).__name__))
        return pd.DataFrame(rows, columns=["text", "status", "reason"])

    kind = (
        F.when(F.col("content_type").startswith("image/"), "photo").when(F.col("content_type").rlike("csv|spreadsheet|excel"), "spreadsheet")
        .when(F.col("content_type") == "message/rfc822", "email").otherwise("document")
    )
    rows = files.withColumn("r", read("content_type", "content"))
    return rows.select(
        "filename", "content_type", F.left(F.btrim("r.text", F.lit(" \t\r\n")), F.lit(size)).alias("text"), F.col("r.status").alias("status"), F.col("r.reason").alias("reason"), F.sha2("content", 256).alias("checksum"), kind.alias("kind")
    )
