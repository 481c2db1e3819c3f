"""Quality classifier: random-indexing word vectors, pooled, into a small network.

Tokens are runs of one byte class (letters, digits, other signs), hashed into
``SLOTS`` slots together with their case. Every slot has a fixed sparse index vector
of +1 and -1; a slot's word vector is the sum of the index vectors of the
neighbours of its tokens over *all* documents, so corpus statistics
are one table of ``SLOTS * DIM`` numbers, a bound that doesn't grow with the input.
Vectors are weighted down by frequency, scaled to length 1 and averaged over the tokens of a
document; the mean over distinct slots and a few shape numbers go along. A
two-layer numpy network is trained on a bounded sample of labelled documents
(``PER_CLASS`` of each class, drawn by hash), and a temperature fitted on a
fifth of them that it wasn't trained on calibrates its probabilities.

Edge cases: null text counts as empty and gets the score of zero vectors;
without labelled rows of both classes every score is 0; repeated rows score
alike; empty tables give no rows; other columns are ignored. Held-out rows are
never learnt from; labels, lang, source and the key are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.labelled import PER_CLASS, held_out, sigmoid, training_sample
from lossbook.llm.store import saved
from lossbook.llm.words import TERM, Chunk, byte_hashes, chunks, mix, spans_hash

SLOT_BITS, DIM, NONZERO = 13, 32, 2
SLOTS = 1 << SLOT_BITS
HIDDEN, EPOCHS = 24, 300
_CLASS = np.full(256, 3, np.uint8)
_CLASS[TERM] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of each token, in order."""
    kind = _CLASS[chunk.raw]
    size = len(kind)
    first = np.ones(size, bool)
    first[1:] = kind[1:] != kind[:-1]
    first[chunk.offsets[:-1][chunk.offsets[:-1] < size]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], size)
    inside = kind[starts] > 0 if size else np.zeros(0, bool)
    starts, ends = starts[inside], ends[inside]
    upper = (chunk.raw >= 65) & (chunk.raw <= 90)
    capitals = np.concatenate([[0], np.cumsum(upper)])
    case = np.where(capitals[ends] - capitals[starts] > 1, 2, upper[starts]) if len(starts) else starts
    lower = Chunk.__new__(Chunk)
    lower.data = np.where(upper, chunk.raw + 32, chunk.raw).astype(np.uint8)
    slot = mix(spans_hash(byte_hashes(lower), starts, ends) + case.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)
    return slot.astype(np.int64), np.searchsorted(chunk.offsets, starts, side="right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero entries of each slot's index vector."""
    h = mix(np.arange(1, SLOTS * NONZERO + 1, dtype=np.uint64)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def corpus_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (length 1) and frequencies of the slots, over all documents. docs: text."""
    width = DIM + 1

    def count(batches):
        dim, sign = index_vectors()
        total = np.zeros(SLOTS * width)
        for batch in batches:
            for _, chunk in chunks(batch):
                slot, doc = tokens(chunk)
                total[DIM::width] += np.bincount(slot, minlength=SLOTS)
                near = np.flatnonzero(doc[1:] == doc[:-1])
                left, right = slot[near], slot[near + 1]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * width + dim[b, k], weights=sign[b, k], minlength=len(total))
        rows = SLOTS // 64
        table = total.reshape(64, rows * width)
        busy = np.flatnonzero(np.abs(table).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(busy.astype(np.int32)), pa.array([table[k].tobytes() for k in busy], pa.binary())], names=["part", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(data)
                sums[k] = sums[k] + got if k in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])

    parts = map_batches(docs.select("text"), count, "part int, sums binary").repartition("part")
    total = np.zeros((64, SLOTS // 64 * width))
    for k, data in map_batches(parts, add, "part int, sums binary").collect():
        total[k] = np.frombuffer(data)
    total = total.reshape(SLOTS, width)
    vectors, counts = total[:, :DIM], total[:, DIM]
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), counts


def pooled(chunk: Chunk, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean vector over tokens and over distinct slots, their lengths, and shape numbers of each document."""
    slot, doc = tokens(chunk)
    n = chunk.n

    def mean(d: np.ndarray, s: np.ndarray) -> np.ndarray:
        w = weight[s]
        total = np.zeros((n, DIM))
        bounds = np.searchsorted(d, np.arange(n + 1))
        full = bounds[1:] > bounds[:-1]
        if full.any():
            total[full] = np.add.reduceat(vectors[s] * w[:, None], bounds[:-1][full], axis=0)
        return total / np.maximum(np.bincount(d, weights=w, minlength=n), 1e-9)[:, None]

    pairs = np.unique(doc * SLOTS + slot)
    distinct = np.bincount(pairs // SLOTS, minlength=n)
    size = np.bincount(doc, minlength=n)
    same = np.bincount(doc[1:][(slot[1:] == slot[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    near = np.bincount(doc[2:][(slot[2:] == slot[:-2]) & (doc[2:] == doc[:-2])], minlength=n)
    every, kinds = mean(doc, slot), mean(pairs // SLOTS, pairs % SLOTS)
    some = np.maximum(size, 1)
    shape = [np.log1p(size), distinct / np.minimum(some, 400), same / some, near / some, np.linalg.norm(every, axis=1), np.linalg.norm(kinds, axis=1)]
    return np.hstack([every, kinds, np.column_stack(shape)]).astype(np.float32)


@dataclass
class Network:
    """Two layers (tanh, then a logit) over scaled inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Full-batch Adam with weight decay; a fifth of the rows is kept for the temperature."""
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 5 == 0
    net = Network(x[~kept].mean(0), x[~kept].std(0) + 1e-3, rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    a, t, w = (x[~kept] - net.mean) / net.scale, y[~kept].astype(float), weight[~kept] / weight[~kept].sum()
    state = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1)) for _ in range(2)]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(a @ net.w1 + net.b1)
        wrong = w * (sigmoid(h @ net.w2 + net.b2) - t)
        back = np.outer(wrong, net.w2) * (1 - h**2)
        slopes = [a.T @ back + 1e-3 * net.w1, back.sum(0), h.T @ wrong + 1e-3 * net.w2, np.array([wrong.sum()])]
        moves = []
        for k, g in enumerate(slopes):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            moves.append(0.02 * state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-9))
        net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    z, t, w = net.logit(x[kept]), y[kept], weight[kept]
    grid = np.geomspace(0.5, 10, 40)
    loss = [float((w * np.where(t == 1, np.logaddexp(0, -z / g), np.logaddexp(0, z / g))).sum()) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))]) if len(z) else 1.0
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    weight: np.ndarray
    net: Network | None

    def score(self, chunk: Chunk) -> np.ndarray:
        if self.net is None:
            return np.zeros(chunk.n)
        return self.net.probability(pooled(chunk, self.vectors, self.weight).astype(float))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Classifier:
    """Word vectors from all documents, a network from at most ``per_class`` labelled documents of each class that aren't held out."""
    vectors, counts = corpus_vectors(docs)
    vectors, share = np.round(vectors, 6).astype(np.float32), counts / max(counts.sum(), 1)
    weight = (1e-3 / (1e-3 + share)).astype(np.float32)
    sample = saved(training_sample(docs, labels, label, per_class), "quality-sample")

    def measure(batches):
        for batch in batches:
            for row, chunk in chunks(batch):
                m = pooled(chunk, vectors, weight)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(row, chunk.n), pa.array([x.tobytes() for x in m], pa.binary())], names=["y", "m"])

    rows = map_batches(sample, measure, "y int, m binary").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Classifier(vectors, weight, None)
    x = np.stack([np.frombuffer(r["m"], np.float32) for r in rows]).astype(float)
    order = np.lexsort((*x.T[:8], y))
    x, y = x[order], y[order]
    base = {r["y"]: r["n"] for r in labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = np.where(y == 1, base.get(1, 1) / (y == 1).sum(), base.get(0, 1) / (y == 0).sum())
    return Classifier(vectors, weight, train(x, y, size))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score (double), predicted (int) of every document."""
    docs = docs.select(key, F.col(text).alias("text"))
    classifier = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for row, chunk in chunks(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, chunk.n), pa.array(classifier.value.score(chunk))], names=[key, "score"])

    scored = map_batches(docs, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
