"""Periodic runs: stretches of words that repeat themselves, found and collapsed.

A run is a stretch of consecutive words whose smallest period is q, that is at least ``min_words`` and ``min_exponent`` times q long, and that
no neighbouring word extends with period q. Runs are found by the divide and conquer of Main and Lorentz on interned word ids: a document is
halved, and halves again; a run lies whole in the part whose middle it crosses first, so each part is asked only for the runs across its middle.
Such a run has half of its length on one side of the middle, so the words next to the middle there, half the shortest length less q of them, come again q
words on: the periods of all parts of one level, in all documents of a batch, are the distances at which the word next to the middle comes again, tried at once against a few words of that block, and the Z-values at
the middle give how far each period left over extends to either side. A part with few such periods compares the words directly; a
part with many (a text of one word) makes its Z-functions once, so a part costs time in proportion to its length. Intervals found again with multiples
of their period, or cut at the edge of a part whose parent holds them whole, are taken out: the smallest period stays.

A document is worked on by itself, within one Arrow batch: nothing is shuffled, however the rows are skewed.

Edge cases: null text has no words, no runs and collapses to ''; texts shorter than a run have none; words are compared exactly, byte by byte; rows with
null or repeated keys are each a document; a very long text is read whole, n log n in time and about 200 bytes a word; an empty table gives an empty result; other columns are left out unless named in ``carry``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.words import Chunk, chunks

#: From so many periods on a part makes its Z-functions instead of comparing words period by period.
MANY = 16
#: Parts of so many words are compared many at once, ``BLOCK`` rows at a time.
SHORT, BLOCK = 64, 1 << 13
RESULT = "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def interned(chunk: Chunk) -> np.ndarray:
    """A number for each word of the chunk, equal for equal words only."""
    ends = np.concatenate([[0], np.cumsum(chunk.ends - chunk.starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk.starts), [None, pa.py_buffer(ends), pa.py_buffer(chunk.raw[chunk.nonspace])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int32)


def z_function(s: np.ndarray) -> np.ndarray:
    """How many words from each place on equal those from the beginning on."""
    words, n = s.tolist(), len(s)
    z = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def _by_z(part: np.ndarray, middle: int, q: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch with each period around the middle of a part."""
    left, right, mark = part[:middle][::-1], part[middle:], np.array([-1], np.int32)
    if to_right:  # the words at the middle come again q words on
        ahead = z_function(right)[q]
        back = z_function(np.concatenate([left, mark, part[::-1]]))[len(left) + 1 + len(right) - q]
        return middle - back, middle + q + ahead
    back = z_function(left)[q]
    ahead = z_function(np.concatenate([right, mark, part]))[len(right) + 1 + middle - q]
    return middle - q - back, middle + ahead


def _by_words(part: np.ndarray, middle: int, q: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``_by_z``, by comparing the part with itself q words on."""
    starts, ends = np.empty_like(q), np.empty_like(q)
    for k, step in enumerate(q):
        differ = part[:-step] != part[step:]
        at = middle if to_right else middle - step
        ahead = differ[at:].argmax() if differ[at:].any() else len(differ) - at
        back = differ[:at][::-1].argmax() if differ[:at].any() else at
        starts[k], ends[k] = at - back, at + ahead + step
    return starts, ends


def _in_rows(ids: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, q: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``_by_words`` for many short parts at once, one row each; places are those of ids."""
    column = np.arange(int((high - low).max(initial=1)))
    at = (middle if to_right else middle - q) - low
    here = low[:, None] + column
    there = here + q[:, None]
    differ = there >= high[:, None]
    differ |= ids[np.minimum(here, len(ids) - 1)] != ids[np.minimum(there, len(ids) - 1)]
    ahead = (differ & (column >= at[:, None])).argmax(axis=1)
    before = differ & (column < at[:, None])
    back = np.where(before.any(axis=1), before.shape[1] - before[:, ::-1].argmax(axis=1), 0)
    return low + back, low + ahead + q


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each interval once, with its smallest period, by start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


class Places:
    """Where each word occurs: all places in the order of their word, then of themselves."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.sorted = np.sort(ids.astype(np.int64) * self.n + np.arange(self.n))

    def between(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the request, place) of each occurrence of its word in low..high, by request and place."""
        base = self.ids[word].astype(np.int64) * self.n
        first, last = np.searchsorted(self.sorted, base + low), np.searchsorted(self.sorted, base + high, side="right")
        many = np.maximum(last - first, 0)
        request = np.repeat(np.arange(len(word)), many)
        at = np.arange(len(request)) + np.repeat(first - np.cumsum(many) + many, many)
        return request, self.sorted[at] - base[request]


def _crossing(places: Places, low, middle, high, first, last, min_words: int, exponent: int):
    """Runs across the middles of parts [low, high) of documents [first, last)."""
    ids, most = places.ids, (high - low) // exponent
    out = []

    def found(node, q, start, end) -> None:
        long = end - start >= np.maximum(min_words, exponent * q)
        out.append(np.stack([x[long] for x in (start, end, q, first[node], last[node])]))

    for to_right in (True, False):
        node, at = places.between(middle, middle + 1, middle + most) if to_right else places.between(middle - 1, middle - 1 - most, middle - 2)
        q = at - middle[node] if to_right else middle[node] - 1 - at
        half = (np.maximum(min_words, exponent * q) + 1) // 2
        keep = np.arange(len(q)) if to_right else np.flatnonzero(half <= (middle - low)[node])[::-1]
        block = half - q
        for eighths in (8, 4, 2, 6, 1, 3, 5, 7):
            at = (block[keep] - 1) * eighths // 8
            here = middle[node[keep]] + at if to_right else middle[node[keep]] - 1 - at
            keep = keep[ids[here] == ids[here + (q[keep] if to_right else -q[keep])]]
        short = (high - low)[node[keep]] <= SHORT
        few, keep = keep[short], keep[~short]
        for k in range(0, len(few), BLOCK):
            of = few[k : k + BLOCK]
            found(node[of], q[of], *_in_rows(ids, low[node[of]], middle[node[of]], high[node[of]], q[of], to_right))
        cuts = np.flatnonzero(np.diff(node[keep])) + 1
        for of in np.split(keep, cuts) if len(keep) else []:
            k = node[of[0]]
            start, end = (_by_z if len(of) >= MANY else _by_words)(ids[low[k] : high[k]], int(middle[k] - low[k]), q[of], to_right)
            found(node[of], q[of], start + low[k], end + low[k])
    if not out:
        return []
    start, end, period, begins, stops = np.concatenate(out, axis=1)
    wider = (start > begins) & (ids[start - 1] == ids[start - 1 + period])
    wider |= (end < stops) & (ids[np.minimum(end, len(ids) - 1)] == ids[end - period])
    return [_smallest(start[~wider], end[~wider], period[~wider])]


def runs_of(ids: np.ndarray, offsets: np.ndarray, min_words: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the documents ids[offsets[i]:offsets[i + 1]]."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    found = [(np.zeros(0, np.int64),) * 3]
    low, high = offsets[:-1], offsets[1:]
    first, last, places = low, high, Places(ids)
    while True:
        big = high - low >= max(min_words, min_exponent)
        low, high, first, last = low[big], high[big], first[big], last[big]
        if not len(low):
            return _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        middle = (low + high) // 2
        found += _crossing(places, low, middle, high, first, last, min_words, min_exponent)
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        first, last = np.concatenate([first, first]), np.concatenate([last, last])


def _batch(chunk: Chunk, min_words: int, min_exponent: int) -> list[pa.Array]:
    offsets = chunk.word_offsets
    start, end, period = runs_of(interned(chunk), offsets, min_words, min_exponent)
    doc = np.searchsorted(offsets, start, side="right") - 1
    edge = np.zeros(len(chunk.starts) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    dropped = np.cumsum(edge) > 0
    hit = np.zeros(chunk.n, bool)
    hit[doc] = True
    texts = []
    for i in range(chunk.n):
        words = chunk.words(i)
        if hit[i]:
            words = [w for w, gone in zip(words, dropped[offsets[i] : offsets[i + 1]], strict=True) if not gone]
        texts.append(b" ".join(words).decode())
    per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=chunk.n))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offsets[doc], end - start, period)], names=["start", "length", "period"])
    return [pa.array(chunk.n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(per), values), pa.array(texts, pa.string())]


def collapse_runs(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """``carry`` columns, n_words, runs (by start, then period) and collapsed: the words outside all runs' repeats, joined by one space.

    Of each run the first period stays and the rest goes.
    """
    names = ["n_words", "runs", "collapsed"]
    carried = [c for c in carry if c not in names]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [RESULT])

    def run(batches):
        for batch in batches:
            for row, chunk in chunks(batch, text):
                own = [batch.column(batch.schema.get_field_index(c)).slice(row, chunk.n) for c in carried]
                yield pa.RecordBatch.from_arrays(own + _batch(chunk, min_words, min_exponent), names=[*carried, *names])

    return map_batches(docs.select(*carried, *[c for c in (text,) if c not in carried]), run, schema)


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value made once a row, not once for each place that reads it."""
    return F.get(F.transform(F.array(value), of), 0)


def with_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, where a tenth of the documents, chosen by h = crc32 of the key as text, repeat some of their words to the end.

    With g = h / 10, n words, a = g % n and p = 1 + (n - a) / (3 + g % 8), all whole, each word i from a on becomes word a + (i - a) % p. A null key has no h.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def altered(words: Column) -> Column:
        n = F.size(words).cast("long")
        shape = F.struct(F.pmod(g, n).alias("a"), (1 + F.floor((n - F.pmod(g, n)) / (3 + F.pmod(g, F.lit(8))))).alias("p"))

        def of(s: Column) -> Column:
            place = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

        return F.when(n > 0, _once(shape, of))

    return docs.select(key, F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(_once(split, altered), F.col(text))).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document: its number of runs, the one of greatest exponent (ties: smallest start, then period), and hashes of all runs and of what is left."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(r["length"] * s["period"] > s["length"] * r["period"], r).otherwise(s))
    rows = found.withColumn("best", best)
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
