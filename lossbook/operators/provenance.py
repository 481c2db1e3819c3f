"""Where a case's values were read: each value looked for, word by word, in all texts of its case, and the edges from a document to what it bears out.

Texts and values are word sequences (normal forms, letters and digits). The values of a case are one row that meets each of its texts, so a text is shuffled once, as it is, and no word of it leaves
its row. A word of a value at place i and a word of a text at place p lie on the diagonal p - i, and unbroken stretches on a diagonal are what value and text have in common. The longest stretch of a
value is its place of origin; a stretch of all its words bears it out.

Stretches are found for an Arrow batch of texts at a time and only the best of each value leaves a text, with what stands around it. A case with more than ``TEXTS_PER_TASK`` texts is dealt over
several tasks, and the best stretch of a case is a partial aggregate, so neither a long text, nor a word that a text repeats, nor a case with a third of all texts meets in one task.

Edge cases: a null or wordless value or text is found nowhere and bears out nothing; of equally long stretches the first source's counts, then the first place in it, then the first in the value;
repeated rows of one (case_id, path, value) count once; null case_ids have no texts; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.functions.text import words
from lossbook.session import ship

AROUND = 6
TEXTS_PER_TASK = 256
#: Meeting words of texts and values that are held at once; a text with more is read place by place.
MEETINGS = 1 << 21
ROWS = 1024


def _met(values: DataFrame, texts: DataFrame) -> DataFrame:
    """case_id, salt, source, tw, held: the words of each text beside the values of its case, an array of (path, w).

    values: case_id, path (one value each), value; texts: case_id, source (unique in the case), text.
    """
    held = values.filter("value is not null").groupBy("case_id").agg(F.collect_set(F.struct("path", "value")).alias("raw"))
    many = texts.groupBy("case_id").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > TEXTS_PER_TASK)
    many = F.broadcast(many.select("case_id", F.ceil(F.col("texts") / TEXTS_PER_TASK).cast("int").alias("salts")))
    parts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    held = held.join(many, "case_id", "left").select("case_id", "raw", F.explode(parts).alias("salt"))
    salt = F.pmod(F.xxhash64("source"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = texts.filter("text is not null").join(many, "case_id", "left").select("case_id", salt.alias("salt"), "source", "text")
    told = F.filter(F.transform("raw", lambda x: F.struct(x["path"].alias("path"), words(x["value"]).alias("w"))), lambda x: F.size(x["w"]) > 0)
    return dealt.join(held, ["case_id", "salt"]).select("case_id", "salt", "source", words(F.col("text")).alias("tw"), told.alias("held"))


def _by_diagonal(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, place, first and length of the best stretch of each key (a value beside a text). Of each meeting the key, its place in the text and in the value."""
    order = np.lexsort((first, place - first, key))
    key, place, first = key[order], place[order], first[order]
    begins = np.ones(len(key), bool)
    begins[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(key)))
    key, place, first = key[at], place[at], first[at]
    order = np.lexsort((first, place, -length, key))
    order = order[np.r_[True, key[order][1:] != key[order][:-1]]]
    return key[order], place[order], first[order], length[order]


def _by_place(tw: np.ndarray, vw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The best stretch of each value in one text with very many meetings: one step for each place, memory as long as the values. starts: where values begin in vw, and the end."""
    n = len(starts) - 1
    inside = np.arange(len(vw)) - np.repeat(starts[:-1], np.diff(starts))
    best = np.zeros((4, n), np.int64)
    best[0] = np.arange(n)
    run = np.zeros(len(vw) + 1, np.int64)
    for p, w in enumerate(tw):
        same = np.flatnonzero(vw == w)
        grown = np.where(inside[same] > 0, run[same], 0) + 1
        run[:] = 0
        run[same + 1] = grown
        of = np.searchsorted(starts, same, side="right") - 1
        begin, at = p - grown + 1, inside[same] - grown + 1
        for k in np.flatnonzero(grown > best[3][of]):
            v = of[k]
            if grown[k] > best[3][v]:
                best[1:, v] = begin[k], at[k], grown[k]
    return tuple(best[:, best[3] > 0])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _longest(batches):
    """case_id, salt, source, path, place, first, length, whole, excerpt: the best stretch of each value in each text."""
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
        tw, held = batch.column("tw"), batch.column("held")
        values = held.flatten()
        vw = values.field("w")
        text_words, value_words = tw.flatten(), vw.flatten()
        codes = pa.concat_arrays([text_words, value_words]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        t, v = codes[: len(text_words)], codes[len(text_words) :]
        sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (tw, held, vw)]
        t_at, h_at, v_at = (np.r_[0, np.cumsum(x)] for x in sizes)
        rows = len(batch)
        row_of_text = np.repeat(np.arange(rows), sizes[0])
        row_of_value = np.repeat(np.arange(rows), sizes[1])
        value_of_word = np.repeat(np.arange(len(vw)), sizes[2])
        width = int(codes.max(initial=0)) + 1
        asked = row_of_value[value_of_word] * width + v
        by_word = np.argsort(asked, kind="stable")
        told = row_of_text * width + t
        low, high = (np.searchsorted(asked[by_word], told, side=s) for s in ("left", "right"))
        meetings = np.r_[0, np.cumsum(high - low)]
        found: list[tuple[np.ndarray, ...]] = []
        row = 0
        while row < rows:
            end = max(int(np.searchsorted(meetings[t_at], meetings[t_at[row]] + MEETINGS, side="right")) - 1, row + 1)
            x, y = t_at[row], t_at[end]
            if meetings[y] - meetings[x] > MEETINGS:
                a, b = h_at[row], h_at[row + 1]
                key, place, first, length = _by_place(t[x:y], v[v_at[a] : v_at[b]], v_at[a : b + 1] - v_at[a])
                found.append((key + a, place, first, length))
            elif meetings[y] > meetings[x]:
                count = (high - low)[x:y]
                word = by_word[_ranges(low[x:y], count)]
                place = np.repeat(np.arange(x, y) - t_at[row_of_text[x:y]], count)
                value = value_of_word[word]
                found.append(_by_diagonal(value, place, word - v_at[value]))
            row = end
        if not found:
            continue
        value, place, first, length = (np.concatenate(c) for c in zip(*found, strict=True))
        of = row_of_value[value]
        start = np.maximum(place - AROUND, 0)
        stop = np.minimum(place + length + AROUND, sizes[0][of])
        around = text_words.take(pa.array(_ranges(t_at[of] + start, stop - start)))
        offsets = pa.array(np.r_[0, np.cumsum(stop - start)].astype(np.int32))
        excerpt = pc.binary_join(pa.ListArray.from_arrays(offsets, around), " ")
        taken = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("case_id").take(taken), batch.column("salt").take(taken), batch.column("source").take(taken), values.field("path").take(pa.array(value)),
                pa.array(place.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(length == sizes[2][value]), excerpt,
            ],
            names=["case_id", "salt", "source", "path", "place", "first", "length", "whole", "excerpt"],
        )


def field_provenance(values: DataFrame, texts: DataFrame) -> DataFrame:
    """case_id, path, source, place, length, whole, excerpt of each value that any text of its case has a word of: its longest stretch and what stands around it."""
    ship(values.sparkSession)
    met = _met(values, texts)
    kind = {f.name: f.dataType.simpleString() for f in met.schema.fields} | {"path": values.schema["path"].dataType.simpleString()}
    stretches = met.mapInArrow(_longest, f"case_id {kind['case_id']}, salt int, source {kind['source']}, path {kind['path']}, place int, first int, length int, whole boolean, excerpt string")
    order = F.struct((-F.col("length")).alias("n"), "source", "place", "first")
    best = stretches.groupBy("case_id", "path").agg(F.min_by(F.struct("source", "place", "length", "whole", "excerpt"), order).alias("b"))
    return best.select("case_id", "path", "b.*")


def evidence_edges(values: DataFrame, texts: DataFrame) -> DataFrame:
    """case_id, src, rel, dst: EVIDENCES from each text to each value of its case that it states in full."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    met = _met(values, texts).select("case_id", "salt", "source", spaced(F.col("tw")).alias("line"), "held")
    stated = F.filter("held", lambda x: F.contains(F.col("line"), spaced(x["w"])))
    whole = met.select("case_id", "salt", "source", F.explode(F.transform(stated, lambda x: x["path"])).alias("path")).distinct()
    named = lambda kind, x: F.concat(F.lit(f"{kind}:"), F.col("case_id").cast("string"), F.lit("/"), F.col(x).cast("string"))
    return whole.select("case_id", named("document", "source").alias("src"), F.lit("EVIDENCES").alias("rel"), named("field", "path").alias("dst"))
