"""Exact substring dedup with fixed-block anchors.

Every document is cut into reference blocks of ``BLOCK`` words, none overlapping.
Blocks are indexed, and every rolling window of ``BLOCK`` words of every document
probes the index. A block that a second place holds too is an anchor. With
``WINDOW >= 2 * BLOCK - 1`` any repeated window holds one of its own
document's blocks whole, so only the windows around anchors can repeat: these
are extended to full ``WINDOW``-word windows, counted over all documents, and neighbouring
repeated windows make up the maximal repeats whose words are removed.

Both counts work alike. Tasks first count among a few million windows of their
own, then send each distinct hash once to the bucket that owns its range; so
the entries for one window number at most one a batch of input, however many
documents hold it, and no pair of places is ever formed. Buckets are streamed in
sorted order (index, probes, then the places that ask), holding only the index.
Their number follows ``spark.sql.shuffle.partitions``. The text is shuffled once.

Windows are equal if their 64-bit hashes are equal; anchors are found by the 32 bits below the bucket's, which may
name a block too many, never one too few. A document's identity in shuffles is a 64-bit hash of its doc_id and text;
a second hash finds documents that share one by chance (some n^2 / 2^65 of n documents) and gives those
another, so that a document's identity rests on 128 bits.

Edge cases: null text is an empty text without words, whose kept text is empty;
documents under ``WINDOW`` words lose nothing; repeated rows are places of their
own, so each loses what the other repeats; a window repeated inside one
document counts; ties need no order, as all places of a repeat lose it; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.store import saved
from lossbook.llm.words import chunks, mix

WINDOW, BLOCK = 35, 18
BATCH_WINDOWS = 1 << 20
INDEX, ONCE, AGAIN, PLACES, KNOWN = range(5)
COUNTS = ONCE
SENT = "bucket int, kind int, a binary, b binary, c binary"


def n_buckets(df: DataFrame) -> int:
    """A power of two, one or two for each shuffle partition."""
    return 1 << min(24, max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()))


def _pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, one byte plane after the other: the upper planes are mostly zeros."""
    steps = np.diff(sorted_values.astype(np.uint32), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(planes.T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "a", "b", "c"])


def sorted_by_bucket(sent: DataFrame) -> DataFrame:
    return sent.repartition("bucket").sortWithinPartitions("bucket", "kind")


class Owned:
    """Hash ranges of the buckets: hash -> (bucket, 32 bits below)."""

    def __init__(self, buckets: int):
        self.bits = buckets.bit_length() - 1
        self.n = buckets

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)

    def cuts(self, sorted_hashes: np.ndarray) -> np.ndarray:
        bounds = np.arange(1, self.n, dtype=np.uint64) << np.uint64(64 - self.bits)
        return np.concatenate([[0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]])


def send_counted(owned: Owned, rolling: list, blocks: list, keys: list, nth: list) -> Iterator[pa.RecordBatch]:
    """One batch of windows: what each bucket needs of it."""
    hashes, counts = np.unique(np.concatenate(rolling), return_counts=True)
    once, again = hashes[counts == 1], hashes[counts > 1]
    own, key, block = (np.concatenate(x) for x in (blocks, keys, nth))
    order = np.argsort(own, kind="stable")
    own, key, block = own[order], key[order], block[order]
    index = own[:0] if blocks is rolling else np.unique(own)  # where all windows are blocks, the counts name them already
    at = [owned.cuts(x) for x in (index, once, again, own)]
    for lo in range(0, owned.n, 64):
        rows = []
        for b in range(lo, min(lo + 64, owned.n)):
            part = [_pack(owned.short(x[c[b] : c[b + 1]])) if c[b] < c[b + 1] else None for x, c in zip((index, once, again), at, strict=False)]
            if part[0]:
                rows.append((b, INDEX, part[0], None, None))
            if part[1] or part[2]:
                rows.append((b, COUNTS, part[1], part[2], None))
            i, j = at[3][b], at[3][b + 1]
            if i < j:
                rows.append((b, PLACES, _pack(owned.short(own[i:j])), key[i:j].tobytes(), block[i:j].astype(np.int32).tobytes()))
        if rows:
            yield _rows(rows)


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """key, block: the reference blocks (their ordinal) that some other place holds too."""
    owned = Owned(buckets)

    def send(batches):
        parts: tuple[list, list, list, list] = ([], [], [], [])
        held = 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, chunk in chunks(batch):
                at, hashes = chunk.rolling(BLOCK)
                long = chunk.n_words >= WINDOW
                chosen = long[chunk.doc[at]] if len(at) else np.zeros(0, bool)
                at, hashes = at[chosen], hashes[chosen]
                inside = at - chunk.word_offsets[chunk.doc[at]]
                first = inside % BLOCK == 0
                for part, new in zip(parts, (hashes, hashes[first], keys[row + chunk.doc[at[first]]], inside[first] // BLOCK), strict=True):
                    part.append(new)
                held += len(hashes)
                if held >= BATCH_WINDOWS:
                    yield from send_counted(owned, *parts)
                    parts, held = ([], [], [], []), 0
        if held:
            yield from send_counted(owned, *parts)

    return map_batches(sorted_by_bucket(map_batches(docs.select("key", "text"), send, SENT)), answer_places, ANSWERED).select("key", F.col("value").alias("block"))


ANSWERED = "token long, key long, value int"


def answer_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, key, value of the places whose hash was counted twice or more; batches come sorted by bucket and kind."""
    bucket, index, held, counts = None, [], [], None
    for batch in batches:
        for b, kind, first, second, third in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, index, held, counts = b, [], [], None
            if kind == INDEX:
                index.append(_unpack(first))
                continue
            if counts is None and (index or kind == PLACES):
                every = [x for x, _ in held] or index
                index, own = np.unique(np.concatenate(every), return_inverse=True) if every else (np.zeros(0, np.uint32), None)
                counts = np.bincount(own, weights=np.concatenate([np.full(len(x), n) for x, n in held])) if held else np.zeros(len(index))
            if kind == COUNTS:
                for data, n in ((first, 1), (second, 2)):
                    if data is not None and counts is None:
                        held.append((_unpack(data), n))
                    elif data is not None and len(index):
                        values = _unpack(data)
                        slot = np.minimum(np.searchsorted(index, values), len(index) - 1)
                        np.add.at(counts, slot[index[slot] == values], n)
            elif len(index):
                values = _unpack(first)
                good = counts[np.minimum(np.searchsorted(index, values), len(index) - 1)] > 1
                token = (np.int64(b) << 32) | values[good].astype(np.int64)
                columns = [pa.array(x) for x in (token, np.frombuffer(second, np.int64)[good], np.frombuffer(third, np.int32)[good])]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "key", "value"])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span : len(x) - span + 1]) if span < width else out


def _runs(key: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions and lengths of runs of consecutive starts with one key and group."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, start[first], np.diff(np.append(first, len(key)))


def _send_windows(buckets: int, parts: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
    key, start, hashes, anchor = (np.concatenate(x) for x in parts)
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    known = counts[inverse] > 1
    is_first = np.zeros(len(hashes), bool)
    is_first[first] = True
    bucket = (mix(anchor) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
    rows = []
    _, at, size = _runs(key[known], start[known], np.zeros(known.sum(), np.int64))
    if len(at):
        owner = key[known][np.cumsum(size) - size]
        for n, i in enumerate(range(0, len(at), 1 << 16)):
            rows.append((n % buckets, KNOWN, at[i : i + (1 << 16)].astype(np.int32).tobytes(), size[i : i + (1 << 16)].astype(np.int32).tobytes(), owner[i : i + (1 << 16)].tobytes()))
    for kind, chosen in ((ONCE, ~known), (AGAIN, known & is_first)):
        k, s, h, b = (x[chosen] for x in (key, start, hashes, bucket))
        order = np.argsort(b, kind="stable")
        k, s, h, b = k[order], s[order], h[order], b[order]
        cuts = np.searchsorted(b, np.arange(buckets + 1))
        for x in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[x], cuts[x + 1]
            if kind == AGAIN:
                rows.append((int(x), AGAIN, h[i:j].tobytes(), None, None))
            else:
                head, at, size = _runs(k[i:j], s[i:j], b[i:j])
                rows.append((int(x), ONCE, h[i:j].tobytes(), np.stack([at, size]).astype(np.int32).tobytes(), k[i:j][head].tobytes()))
            if len(rows) >= 128:
                yield _rows(rows)
                rows = []
    if rows:
        yield _rows(rows)


def _repeats(docs: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """key, start, size: runs of repeated windows, by the words they start at."""
    around = docs.join(anchors.groupBy("key").agg(F.collect_list("block").alias("blocks")), "key").select("key", "text", "blocks")

    def send(batches):
        parts: tuple[list, ...] = ([], [], [], [])
        held = 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            blocks = batch.column(2)
            for row, chunk in chunks(batch):
                hashes = chunk.hashes()
                at, windows = chunk.rolling(WINDOW, hashes)
                grams_at, grams = chunk.rolling(BLOCK, hashes)
                if not len(at):
                    continue
                lists = blocks.slice(row, chunk.n)
                count = lists.value_lengths().to_numpy(zero_copy_only=False)
                word = np.repeat(chunk.word_offsets[:-1], count) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK
                edge = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edge, np.maximum(word - (WINDOW - BLOCK), 0), 1)
                np.add.at(edge, word + 1, -1)
                near = np.cumsum(edge)[at] > 0
                full = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
                full[grams_at] = grams
                least = _sliding_min(full, WINDOW - BLOCK + 1)
                at, windows = at[near], windows[near]
                for part, new in zip(parts, (keys[row + chunk.doc[at]], at - chunk.word_offsets[chunk.doc[at]], windows, least[at]), strict=True):
                    part.append(new)
                held += len(at)
                if held >= BATCH_WINDOWS:
                    yield from _send_windows(buckets, parts)
                    parts, held = ([], [], [], []), 0
        if held:
            yield from _send_windows(buckets, parts)

    def settle(asked, told):
        """Of one bucket: the runs among those asked for whose windows another batch has too."""
        if not asked:
            return
        hashes = np.concatenate([x[0] for x in asked])
        every, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        good = counts[inverse] > 1
        if told:
            good |= np.isin(hashes, np.concatenate(told))
        at, size, key = (np.concatenate([x[k] for x in asked]) for k in (1, 2, 3))
        window = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(hashes))
        run = np.repeat(np.arange(len(at)), size)
        head, start, length = _runs(run[good], window[good], np.zeros(good.sum(), np.int64))
        yield _run_rows(key[run[good][head]], start, length)

    def receive(batches):
        bucket, asked, told = None, [], []
        for batch in batches:
            for b, kind, x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    yield from settle(asked, told)
                    bucket, asked, told = b, [], []
                if kind == KNOWN:
                    yield _run_rows(np.frombuffer(z, np.int64), np.frombuffer(x, np.int32), np.frombuffer(y, np.int32))
                elif kind == AGAIN:
                    told.append(np.frombuffer(x, np.uint64))
                else:
                    at, size = np.frombuffer(y, np.int32).reshape(2, -1).astype(np.int64)
                    asked.append((np.frombuffer(x, np.uint64), at, size, np.frombuffer(z, np.int64)))
        yield from settle(asked, told)

    return map_batches(sorted_by_bucket(map_batches(around, send, SENT)), receive, "key long, start int, size int")


def _run_rows(key: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["key", "start", "size"])


def told_apart(docs: DataFrame) -> DataFrame:
    """key (long), id, text: equal keys for rows that are equal in id and text, and others for all others. docs: id, text."""
    first, second = F.xxhash64("id", "text"), F.xxhash64(F.lit("second"), "text", "id")
    clashes = docs.select(first.alias("first"), second.alias("second")).groupBy("first").agg(F.min("second").alias("a"), F.max("second").alias("b"))
    clashes = saved(clashes.filter("a <> b").select("first", F.lit(True).alias("clash")), "substring-clashes")
    if clashes.isEmpty():
        return docs.select(first.alias("key"), "id", "text")
    return docs.withColumn("first", first).join(clashes, "first", "left").select(F.when(F.col("clash"), second).otherwise(F.col("first")).alias("key"), "id", "text")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """key, n_words, n_removed (long), kept_sha256 and, if asked for, kept_text: the words left, joined by one space."""
    id_type = docs.schema[key].dataType.simpleString()
    docs = told_apart(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    buckets = n_buckets(docs)
    runs = _repeats(docs, _anchors(docs, buckets), buckets)
    runs = runs.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    joined = docs.join(runs, "key", "left").select("id", "text", "starts", "sizes")
    names = [key, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def cut(batches):
        for batch in batches:
            starts, sizes = batch.column(2), batch.column(3)
            for row, chunk in chunks(batch):
                removed, digests, texts = [], [], []
                for i in range(chunk.n):
                    words = chunk.words(i)
                    at = starts[row + i].as_py()
                    if at:
                        edge = np.zeros(len(words) + 1, np.int64)
                        at = np.array(at)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + np.array(sizes[row + i].as_py()) + WINDOW - 1, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        removed.append(int(gone.sum()))
                        words = [words[k] for k in np.flatnonzero(~gone)]
                    else:
                        removed.append(0)
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode())
                columns = [batch.column(0).slice(row, chunk.n), pa.array(chunk.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    schema = f"`{key}` {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_batches(joined, cut, schema)
