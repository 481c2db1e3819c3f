"""Benchmark decontamination: every training passage queries a BM25 index of test items.

The test items are indexed once: postings of (item, BM25 impact) by term, cut
into blocks that know their largest impact. Impacts are divided by the item's
score against itself, so one threshold suits short and long items. Each
document is cut into overlapping passages twice as long as the longest item (so any
copy lies whole in one passage); a passage's terms are its query. Retrieval is block-max WAND with
its fixed threshold taken for many queries at once: where a pointer-by-pointer WAND moves one query's pivot past a block whose
largest impacts stay below the threshold, arrays drop all such (query, block) cells together, and only the postings of the others are
scored. Every item at or above the threshold is retrieved, with no cap. A retrieved item counts as leaked if enough of the ``gram``-word runs of its
question and of its answer (text after the last line break or sentence end)
occur in the document.

The index is built for one slice of at most ``items_per_block`` items at a time, by the hash of id and text,
a proven bound for what is broadcast; more items make more passes over the documents. Queries go through the blocks in groups of
at most ``CELLS`` (query, block) cells, so a text of any length takes no more memory than a chunk of passages.
Item frequencies, mean length and the passage length are those of the whole benchmark, counted
by Spark, so scores don't depend on the blocks.

Edge cases: null text has no terms and no hits; empty items match nothing; items
with equal texts are each reported, those with null or repeated ids too (rows equal in id and text once); repeated documents are each judged; an item
shorter than ``gram`` words is one run; empty tables give no rows; a
document with several passages that hit one item gives one row with the
best score. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.store import saved
from lossbook.llm.words import Chunk, chunks, spans_hash, terms as folded_terms

K1, B = 1.2, 0.75
#: (query, block) cells looked at together.
CELLS = 1 << 22


@dataclass(frozen=True)
class Leak:
    threshold: float = 0.6
    gram: int = 4
    question: float = 0.6
    answer: float = 0.6
    block: int = 16
    items_per_block: int = 20_000


@dataclass(frozen=True)
class Corpus:
    """Figures of the whole benchmark: items, their mean and largest number of terms, and items by term."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    holding: np.ndarray


@dataclass
class Index:
    """Inverted index of items: terms own ranges of block entries, block entries own ranges of postings, in item order."""

    ids: list[int]
    terms: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    upper: np.ndarray
    block_first: np.ndarray
    block_id: np.ndarray
    block_upper: np.ndarray
    posting_first: np.ndarray
    block_essential: np.ndarray
    essential: np.ndarray
    n_blocks: int
    window: int
    question: list[np.ndarray]
    answer: list[np.ndarray]


def _runs(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` terms; fewer terms make one run."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    at = np.arange(max(1, len(hashes) - gram + 1))
    return np.unique(spans_hash(hashes, at, np.minimum(at + gram, len(hashes))))


def _split(text: str) -> tuple[str, str]:
    """Question and answer of an item: the answer is its last line or, on one line, its last sentence."""
    text = text.strip()
    cut = text.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.?!](?=\s)", text)]
        cut = ends[-1] if ends else 0
    return text[:cut], text[cut:]


def _item_terms(items: list[tuple[int, str]]) -> list[np.ndarray]:
    batch = pa.record_batch([pa.array([t or "" for _, t in items], pa.string())], names=["text"])
    whole = [(c, c.hashes()) for c in (folded_terms(c) for _, c in chunks(batch))]
    return [h[c.word_offsets[i] : c.word_offsets[i + 1]] for c, h in whole for i in range(c.n)]


def build_index(items: list[tuple[int, str]], leak: Leak, corpus: Corpus | None = None) -> Index:
    """The index of a block of items by the figures of ``corpus``, or of these items where they are the whole benchmark."""
    items = sorted(items, key=lambda x: (len(x[1] or ""), x[1] or ""))  # blocks of items alike in length have tight bounds
    terms = _item_terms(items)
    size = np.array([len(t) for t in terms], np.int64)
    keys, term = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]), return_inverse=True)
    pair, often = np.unique(term * max(len(items), 1) + np.repeat(np.arange(len(items)), size), return_counts=True)
    owner, items_ = pair // max(len(items), 1), pair % max(len(items), 1)
    if corpus is None:
        n_items, mean, longest, holding = len(items), float(size.mean()) if len(size) else 1.0, int(size.max(initial=1)), np.bincount(owner, minlength=len(keys))
    else:
        n_items, mean, longest = corpus.items, corpus.mean, corpus.longest
        order = np.argsort(corpus.terms)
        holding = corpus.holding[order][np.searchsorted(corpus.terms[order], keys)]
    idf = np.log(1 + (n_items - holding + 0.5) / (holding + 0.5))
    raw = idf[owner] * often * (K1 + 1) / (often + K1 * (1 - B + B * size[items_] / max(mean, 1e-9)))
    impacts = raw / np.bincount(items_, weights=raw, minlength=len(items))[items_]
    first = np.searchsorted(owner, np.arange(len(keys)))
    n_blocks = -(-len(items) // leak.block)
    blocks, begin = np.unique(owner * n_blocks + items_ // leak.block, return_index=True)
    order = np.lexsort((impacts, items_))  # an item's weakest postings, as far as they stay below the threshold together, can't retrieve it alone
    run = np.cumsum(impacts[order])
    ahead = np.concatenate([[0.0], run])[np.searchsorted(items_[order], items_[order])]
    essential = np.zeros(len(items_), bool)
    essential[order] = run - ahead >= leak.threshold - 1e-9
    parts = [_split(t or "") for _, t in items]
    grams = []
    for side in (0, 1):
        batch = pa.record_batch([pa.array([p[side] for p in parts], pa.string())], names=["text"])
        got = [(c, c.hashes()) for c in (folded_terms(c) for _, c in chunks(batch))]
        grams.append([_runs(h[c.word_offsets[i] : c.word_offsets[i + 1]], leak.gram) for c, h in got for i in range(c.n)])
    return Index(
        [k for k, _ in items], keys, items_, impacts, np.maximum.reduceat(impacts, first) if len(first) else impacts,
        np.searchsorted(blocks // max(n_blocks, 1), np.arange(len(keys) + 1)), blocks % max(n_blocks, 1),
        np.maximum.reduceat(impacts, begin) if len(begin) else impacts, np.append(begin, len(items_)),
        np.maximum.reduceat(essential, begin) if len(begin) else essential, np.bincount(owner, weights=essential, minlength=len(keys)) > 0,
        n_blocks, 2 * longest, grams[0], grams[1],
    )


def _ragged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of many ranges, and the range each belongs to."""
    size = last - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def _distinct(values: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct values below size: by a table where one is small, else by sorting."""
    if size > 1 << 26:
        return np.unique(values)
    there = np.zeros(size, bool)
    there[values] = True
    return np.flatnonzero(there)


def block_max_wand(index: Index, passage: np.ndarray, term: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of every item whose impacts over a passage's terms add up to theta.

    passage, term: the distinct (passage, position in index.terms) pairs of many queries. Bounds go from coarse to
    fine for all queries at once: some term that can lift an item of the block over theta, the largest impacts in a
    block of items, then the postings themselves.
    """
    theta -= 1e-9
    queries = int(passage.max(initial=-1)) + 1
    entry, of = _ragged(index.block_first[term], index.block_first[term + 1])
    cell = passage[of] * index.n_blocks + index.block_id[entry]
    size = queries * index.n_blocks
    alive = np.zeros(size, bool)
    alive[cell[index.block_essential[entry]]] = True
    entry, of, cell = (x[alive[cell]] for x in (entry, of, cell))
    alive = np.bincount(cell, weights=index.block_upper[entry], minlength=size) >= theta
    chosen = alive[cell]
    entry, row = entry[chosen], passage[of[chosen]]
    at, of = _ragged(index.posting_first[entry], index.posting_first[entry + 1])
    cell, inverse = np.unique(row[of] * len(index.ids) + index.items[at], return_inverse=True)
    score = np.bincount(inverse, weights=index.impacts[at], minlength=len(cell))
    good = score >= theta
    return cell[good] // len(index.ids), cell[good] % len(index.ids), score[good]


def _hits(chunk: Chunk, index: Index, leak: Leak) -> Iterator[tuple[int, int, float, float, float]]:
    """(document in the chunk, item, score, question overlap, answer overlap) of every leak."""
    folded = folded_terms(chunk)
    hashes = folded.hashes()
    if not len(hashes) or not len(index.terms):
        return
    slot = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[slot] == hashes
    stride = index.window // 2
    n, base = folded.n_words, folded.word_offsets[:-1]
    passages = np.maximum(1, -(-(n - stride) // stride)) * (n > 0)
    doc = np.repeat(np.arange(folded.n), passages)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(passages) - passages, passages)
    begin = base[doc] + nth * stride
    end = np.minimum(begin + index.window, base[doc] + n[doc])
    total = np.concatenate([[0], np.cumsum(known & index.essential[slot])])
    able = np.flatnonzero(total[end] > total[begin])
    doc, begin, end = doc[able], begin[able], end[able]
    best: dict[tuple[int, int], float] = {}
    group = max(1, CELLS // max(index.n_blocks, 1))
    for lo in range(0, len(doc), group):
        at, of = _ragged(begin[lo : lo + group], end[lo : lo + group])
        seen = known[at]
        pair = _distinct(of[seen] * len(index.terms) + slot[at[seen]], min(group, len(doc) - lo) * len(index.terms))
        for p, item, score in zip(*block_max_wand(index, pair // len(index.terms), pair % len(index.terms), leak.threshold), strict=True):
            place = (int(doc[lo + p]), int(item))
            best[place] = max(best.get(place, 0.0), float(score))
    own: dict[int, np.ndarray] = {}
    for (d, item), score in sorted(best.items()):
        if d not in own:
            own = {d: _runs(hashes[folded.word_offsets[d] : folded.word_offsets[d + 1]], leak.gram)}
            for short in range(1, leak.gram):
                own[-short] = _runs(hashes[folded.word_offsets[d] : folded.word_offsets[d + 1]], short)
        sides = []
        for runs, text in ((index.question[item], 0), (index.answer[item], 1)):
            have = np.isin(runs, own[d])
            if len(runs) == 1 and not have[0]:
                have = np.array([any(np.isin(runs, own[-s])[0] for s in range(1, leak.gram))])
            sides.append(float(have.mean()) if len(runs) else 1.0)
        if sides[0] >= leak.question and sides[1] >= leak.answer:
            yield d, item, score, sides[0], sides[1]


def item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple[object, str]]]:
    """The items (h, item_id, text; no two rows alike) in slices of at most ``size`` by their hash, each read from the table when its turn comes."""
    last = None
    while True:
        part = items if last is None else items.filter(F.col("h") > last)
        rows = part.orderBy("h", "item_id", "text").limit(size).collect()
        if not rows:
            return
        if len(rows) == size and rows[0][0] != rows[-1][0]:
            rows = [r for r in rows if r[0] != rows[-1][0]]
        last = rows[-1][0]
        yield [(r[1], r[2]) for r in rows]


def indexed_items(benchmark: DataFrame) -> DataFrame:
    """h, item_id, text: the rows of the benchmark, those equal in both once."""
    return saved(benchmark.select(F.xxhash64("item_id", F.lit("item"), "text").alias("h"), "item_id", "text").distinct(), "benchmark-items")


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """n_terms and the distinct terms (64-bit hashes) of each item."""

    def run(batches):
        for batch in batches:
            for _, chunk in chunks(batch):
                folded = folded_terms(chunk)
                hashes, at = folded.hashes(), folded.word_offsets
                found = [np.unique(hashes[at[i] : at[i + 1]]).view(np.int64) for i in range(folded.n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate(found), pa.int64()))],
                    names=["n_terms", "terms"],
                )

    return map_batches(benchmark.select("text"), run, "n_terms long, terms array<long>")


def corpus_figures(benchmark: DataFrame) -> Callable[[list[tuple[int, str]]], Corpus]:
    """Counts once over all items with Spark; the function it gives looks up the terms of one block."""
    spark = benchmark.sparkSession
    items = saved(benchmark_terms(benchmark), "benchmark-terms")
    n, mean, longest = items.agg(F.count(F.lit(1)), F.mean("n_terms"), F.max("n_terms")).first()
    holding = saved(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("holding")), "benchmark-holding")

    def of(block: list[tuple[int, str]]) -> Corpus:
        mine = np.unique(np.concatenate([*_item_terms(block), np.zeros(0, np.uint64)]))
        found = holding.join(F.broadcast(spark.createDataFrame(pa.table({"term": mine.view(np.int64)}))), "term").toArrow()
        return Corpus(n, mean, longest, found["term"].to_numpy().view(np.uint64), found["holding"].to_numpy())

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, score, question_overlap, answer_overlap: one row for each document and item that leaked into it."""
    spark: SparkSession = docs.sparkSession
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id {id_type}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    benchmark = indexed_items(benchmark)
    arrow_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    figures = corpus_figures(benchmark) if benchmark.count() > leak.items_per_block else None
    for items in item_blocks(benchmark, leak.items_per_block):
        index = spark.sparkContext.broadcast(build_index(items, leak, figures and figures(items)))

        def run(batches, index=index):
            for batch in batches:
                keys = batch.column(0)
                for row, chunk in chunks(batch):
                    found = list(_hits(chunk, index.value, leak))
                    if found:
                        d, item, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array([row + x for x in d])), pa.array([index.value.ids[k] for k in item], arrow_type), *map(pa.array, rest)],
                            names=[key, "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        out = out.unionByName(map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """The rows that no item leaked into, columns unchanged; a row is known by its doc_id and text, so null and repeated ids are judged row by row."""
    named = {c.lower() for c in docs.columns}
    row = next(x for x in ("row" + "_" * k for k in range(len(named) + 1)) if x not in named)
    told = docs.withColumn(row, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return told.join(leaks(told, benchmark, leak, key=row).select(row).distinct(), row, "left_anti").select(*docs.columns)
