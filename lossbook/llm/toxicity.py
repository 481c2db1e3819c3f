"""Toxicity by weak supervision.

Many voters look at each document: lexicon voters, one for each of ``LEXICON_VOTERS``
groups of a lexicon of words and word beginnings mined from labelled documents, and pattern
voters (hits at several densities and counts, the clearest hit,
a fixed list of insults, and absence of all of them). A generative label model is fitted to the votes on all
documents without any label: expectation maximisation, from the majority of votes on, gives the class prior, each voter's
chances of its votes in either class, and the correlations of voters that remain within a class, by which correlated voters share
their weight. Its posteriors are the only labels of a linear classifier over hit counts and votes.

Labels serve for the lexicon alone, from at most ``PER_CLASS`` labelled documents of each class (bounded,
drawn by hash). The votes on all documents are counted by pattern with Spark, and each round of the label model sums over the
patterns where they lie; the classifier is fitted on at most ``PER_CLASS`` documents of each side of the
posterior, drawn by hash. The whole text of every document is read once.

Edge cases: null text counts as empty and gets the score of a document without
hits; without labelled rows of both classes, or without a word that tells them apart, every score is 0; repeated
rows score alike; empty tables give no rows; very long texts are read whole; other columns are ignored, whatever their names. Held-out
rows are never learnt from; labels, lang, source and the key are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.labelled import PER_CLASS, held_out, logistic, sigmoid, training_sample
from lossbook.llm.store import saved
from lossbook.llm.words import Chunk, byte_hashes, chunks, mix, spans_hash, terms

# Common insults in English, German, French and Spanish.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "dumb", "imbecile",
    "jerk", "filthy", "vermin", "freak",
    "idioten", "dummkopf", "trottel", "abschaum", "widerlich", "versager", "arschloch", "schwachkopf", "ungeziefer",
    "idiote", "imbécile", "crétin", "connard", "abruti", "salaud", "ordure", "vermine", "débile",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso", "inútil", "payaso",
)
PREFIXES = (5, 6, 7, 8)
LEXICON = 512
LEXICON_VOTERS = 16
MIN_DOCS = 5
#: How many times likelier a lexicon entry must be in toxic documents than in others.
MIN_LIFT = 20
ROUNDS = 15


def features(chunk: Chunk) -> tuple[Chunk, list[tuple[np.ndarray, np.ndarray]]]:
    """Of the folded chunk, (word index, hash) of whole words and of word beginnings of each length in bytes."""
    folded = terms(chunk)
    values = byte_hashes(folded)
    size = folded.ends - folded.starts
    out = [(np.arange(len(size)), spans_hash(values, folded.starts, folded.ends))]
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        out.append((at, mix(spans_hash(values, folded.starts[at], folded.starts[at] + k) + np.uint64(k))))
    return folded, out


def mined_lexicon(sample: DataFrame, size: int = LEXICON, min_docs: int = MIN_DOCS) -> list[tuple[int, int, int]]:
    """(hash, toxic documents, other documents) of the features that speak most clearly for label 1, by log-likelihood ratio."""

    def count(batches):
        hashes, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for row, chunk in chunks(batch):
                folded, found = features(chunk)
                for at, h in found:
                    doc = folded.doc[at]
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    hashes.append(h[new])
                    labels.append(y[row + doc[new]])
        every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        y = np.concatenate(labels)
        ones = np.bincount(inverse, weights=y, minlength=len(every)).astype(np.int64)
        both = np.bincount(inverse, minlength=len(every))
        yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(ones), pa.array(both - ones)], names=["h", "ones", "zeros"])

    sums = map_batches(sample, count, "h long, ones long, zeros long").groupBy("h").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return []
    a, b = F.col("ones") + 0.5, F.col("zeros") + 0.5
    share = (a + b) / (n[0] + n[1] + 1)
    ratio = a * F.log(a / (share * n[1])) + b * F.log(b / (share * n[0]))
    clear = sums.filter((F.col("ones") >= min_docs) & (a / n[1] > MIN_LIFT * b / n[0])).withColumn("ratio", ratio)
    return [(r["h"], r["ones"], r["zeros"]) for r in clear.orderBy(F.desc("ratio"), "h").limit(size).collect()]


@dataclass
class Lexicon:
    """Sorted hashes, and for each its group (by strength) and log odds."""

    hashes: np.ndarray
    group: np.ndarray
    odds: np.ndarray

    def matrix(self, chunk: Chunk) -> np.ndarray:
        """For each document: distinct hits by group, log-odds sums, hits, share of words hit, longest words hit, insults, size."""
        folded, found = features(chunk)
        n = chunk.n
        groups = np.zeros((n, LEXICON_VOTERS))
        hit = np.zeros(len(folded.starts), bool)
        best = np.zeros(len(folded.starts))
        insult = np.zeros(n)
        for k, (at, h) in enumerate(found):
            if len(self.hashes):
                slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                good = self.hashes[slot] == h
                doc, which = folded.doc[at[good]], slot[good]
                pair = np.unique(doc * len(self.hashes) + which)
                np.add.at(groups, (pair // len(self.hashes), self.group[pair % len(self.hashes)]), 1)
                hit[at[good]] = True
                best[at[good]] = np.maximum(best[at[good]], self.odds[which])
            if k == 0:
                insult = np.bincount(folded.doc[at[np.isin(h, _INSULT_HASHES)]], minlength=n).astype(float)
        words = np.maximum(folded.n_words, 1)
        hits = np.bincount(folded.doc[hit], minlength=n)
        total = np.bincount(folded.doc, weights=best, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, folded.doc[hit], best[hit])
        return np.column_stack([groups, hits, total, hits / words, total / words, top, insult, insult / words, np.log1p(folded.n_words)])


def _insult_hashes() -> np.ndarray:
    batch = pa.record_batch([pa.array([" ".join(INSULTS)])], names=["text"])
    return np.concatenate([features(c)[1][0][1] for _, c in chunks(batch)])


_INSULT_HASHES = _insult_hashes()


def votes(m: np.ndarray) -> np.ndarray:
    """+1 toxic, -1 clean, 0 abstains; one column a voter."""
    groups, (hits, total, share, _, top, insult, _, _) = m[:, :LEXICON_VOTERS], m[:, LEXICON_VOTERS:].T
    lexicon = np.where(groups >= 1, 1, 0)
    patterns = [
        np.where(hits >= 2, 1, np.where(hits == 0, -1, 0)),
        np.where(hits >= 4, 1, 0),
        np.where(share >= 0.01, 1, np.where(share < 0.002, -1, 0)),
        np.where(share >= 0.03, 1, 0),
        np.where(total >= 6, 1, np.where(total < 1.5, -1, 0)),
        np.where(top >= 3, 1, np.where(top < 1.5, -1, 0)),
        np.where(insult >= 1, 1, 0),
        np.where((insult == 0) & (groups[:, : LEXICON_VOTERS // 2].sum(1) == 0), -1, 0),
    ]
    return np.column_stack([lexicon, *patterns])


@dataclass
class LabelModel:
    """P(vote | class) of each voter, the class prior, and a weight that correlated voters share."""

    chance: np.ndarray
    prior: float
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = v + 1
        odds = np.log(self.chance[1]) - np.log(self.chance[0])
        score = sum(self.weight[j] * odds[j, at[:, j]] for j in range(v.shape[1]))
        return sigmoid(score + np.log(self.prior / (1 - self.prior)))


def moments(v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For both classes, weighted by n and the chance p of class 1: total, counts of each vote of each voter, sums of vote products."""
    out = []
    for q in (n * (1 - p), n * p):
        counts = [(q[:, None] * (v == k)).sum(0) for k in (-1, 0, 1)]
        out.append(np.concatenate([[q.sum()], np.concatenate(counts), ((q[:, None] * v).T @ v).ravel()]))
    return np.stack(out)


def label_model(sums: np.ndarray) -> LabelModel:
    """Chances and prior from the moments; voters whose votes correlate within classes by more than 0.2 share their weight."""
    voters = int(round((np.sqrt(9 + 4 * (sums.shape[1] - 1)) - 3) / 2))
    counts = sums[:, 1 : 1 + 3 * voters].reshape(2, 3, voters).transpose(0, 2, 1) + 1.0
    inside = np.zeros((voters, voters))
    for total, row in zip(sums[:, 0], sums, strict=True):
        mean = (row[1 + 2 * voters : 1 + 3 * voters] - row[1 : 1 + voters]) / max(total, 1e-9)
        inside += row[1 + 3 * voters :].reshape(voters, voters) - total * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(inside), 0)) + 1e-9
    related = np.abs(inside / np.outer(spread, spread))
    np.fill_diagonal(related, 1.0)
    prior = float(np.clip(sums[1, 0] / max(sums[:, 0].sum(), 1e-9), 1e-4, 0.5))
    return LabelModel(counts / counts.sum(2, keepdims=True), prior, 1 / np.where(related > 0.2, related, 0).sum(1))


def majority(v: np.ndarray) -> np.ndarray:
    """The first posterior: more votes for label 1 than against it, by more than one."""
    return sigmoid(v.sum(1) - 1.0)


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel | None:
    """patterns: votes (a byte for each voter), n (documents). Every round sums over all patterns in their tasks."""
    model: LabelModel | None = None
    for _ in range(rounds):

        def sums(batches, model=model):
            total = None
            for batch in batches:
                if batch.num_rows:
                    v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(float)
                    part = moments(v, batch.column(1).to_numpy().astype(float), majority(v) if model is None else model.posterior(v.astype(np.int64)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(r[0]).reshape(2, -1) for r in map_batches(patterns.select("votes", "n"), sums, "sums binary").collect()]
        if not parts:
            return None
        model = label_model(np.round(sum(parts), 6))
    return model


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def _shaped(m: np.ndarray) -> np.ndarray:
    """Classifier inputs: damped counts and the voters' votes."""
    return np.hstack([np.log1p(m[:, : LEXICON_VOTERS + 2]), np.sqrt(m[:, LEXICON_VOTERS + 2 :]), votes(m)])


def lexicon_of(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """The lexicon that at most ``per_class`` labelled documents of each class give, none of them held out."""
    found = mined_lexicon(saved(training_sample(docs, labels, label, per_class), "toxicity-sample"))
    h = np.array([x[0] for x in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    ones, zeros = (np.array([x[k] for x in found], float)[order] for k in (1, 2))
    odds = np.log((ones + 0.5) / (zeros + 0.5))
    rank = np.empty(len(h), np.int64)
    rank[np.argsort(-odds, kind="stable")] = np.arange(len(h))
    return Lexicon(h[order], rank * LEXICON_VOTERS // max(len(h), 1), odds - (odds.min(initial=0.0)))


def voted(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, votes (a byte for each voter), x (classifier inputs, 32-bit), draw: one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            for row, chunk in chunks(batch):
                m = shared.value.matrix(chunk)
                columns = [[r.tobytes() for r in votes(m).astype(np.int8)], [r.tobytes() for r in _shaped(m).astype(np.float32)]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, chunk.n), *[pa.array(c, pa.binary()) for c in columns], batch.column(2).slice(row, chunk.n)], names=["key", "votes", "x", "draw"]
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit("toxicity")).alias("draw"))
    return map_batches(rows, run, f"key {docs.schema[key].dataType.simpleString()}, votes binary, x binary, draw long")


def fit_classifier(rows: DataFrame, patterns: DataFrame, model: LabelModel, per_class: int = PER_CLASS) -> Classifier | None:
    """A linear classifier on the posteriors of at most ``per_class`` documents of either side of 0.5; None where all are on one side."""

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.posterior(v))], names=["votes", "n", "p"])

    judged = saved(map_batches(patterns, judge, "votes binary, n long, p double"), "toxicity-posteriors")
    x, p, size = [], [], []
    for side in (F.col("p") >= 0.5, F.col("p") < 0.5):
        there = judged.filter(side)
        drawn = rows.join(there, "votes").orderBy("draw", "x").limit(per_class).select("x", "p").collect()
        n = there.agg(F.sum("n")).first()[0] or 0
        if not drawn:
            return None
        x += [np.frombuffer(r["x"], np.float32).astype(float) for r in drawn]
        p += [r["p"] for r in drawn]
        size += [n / len(drawn)] * len(drawn)
    x, p, size = np.stack(x), np.array(p), np.array(size)
    size *= len(size) / size.sum()
    mean, scale = x.mean(0), x.std(0) + 1e-3
    weights, bias = logistic((x - mean) / scale, p, size, ridge=3.0)
    return Classifier(weights, bias, mean, scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score (double), predicted (int) of every document."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lexicon = lexicon_of(docs, labels)
    rows = saved(voted(docs, lexicon), "toxicity-votes")
    patterns = saved(rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "toxicity-patterns")
    model = fit_label_model(patterns) if len(lexicon.hashes) else None
    if model is None:
        scored = rows.select("key", F.lit(0.0).alias("score"))
    else:
        classifier = fit_classifier(rows, patterns, model)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    read = b"".join(batch.column(1).to_pylist())
                    if classifier is None:
                        score = model.posterior(np.frombuffer(read, np.int8).reshape(batch.num_rows, -1).astype(np.int64))
                    else:
                        score = classifier.score(np.frombuffer(read, np.float32).reshape(batch.num_rows, -1).astype(float))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["key", "score"])

        scored = map_batches(rows.select("key", "votes" if classifier is None else "x"), run, f"key {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
