"""Similarity expressions over two columns; null stands for a signal that couldn't be compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lossbook.functions.text import normalise, normalise_organisation, tokens

EARTH_RADIUS_KM = 6371.0088


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table for each letter of a."""
    letters = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, 1))
    places = F.sequence(F.lit(1), F.length(b))
    empty = F.concat(F.array(F.lit(0)), F.transform(places, lambda _: F.lit(0)))

    def row(previous: Column, letter: Column) -> Column:
        def cell(current: Column, j: Column) -> Column:
            same = F.substring(b, j, 1) == letter
            best = F.when(same, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(current, j - 1)))
            return F.concat(current, F.array(best))

        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(letters, empty, row), -1)


def _common_letters(a: str, b: str) -> int:
    """The same length by bit rows: one machine word for each letter of b."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for letter in b:
        hit = row & places.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Names of up to so many letters fit the bits of a machine word.
WORD_LETTERS = 63


def _codes(names: np.ndarray) -> np.ndarray:
    """A row of letter codes for each name, filled up with zeros."""
    text = names.astype(str)
    return text.view(np.uint32).reshape(len(text), -1) if text.dtype.itemsize else np.zeros((len(text), 0), np.uint32)


def _common_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_common_letters`` of many pairs of short names at once: one word a pair, one step for each letter of the longest b."""
    left, right = _codes(a), _codes(b)
    bits = np.uint64(1) << np.arange(left.shape[1], dtype=np.uint64)
    full = ((left != 0) * bits).sum(axis=1, dtype=np.uint64)
    row = full.copy()
    for j in range(right.shape[1]):
        hit = row & ((left == right[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        row = ((row + hit) | (row - hit)) & full
    return (np.bitwise_count(full) - np.bitwise_count(row)).astype(np.int64)


def _common_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.array([None] * len(a), dtype="Int32")
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = a.to_numpy(object)[known], b.to_numpy(object)[known]
    size = np.array([max(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
    short = size <= WORD_LETTERS
    if short.any():
        out[known[short]] = _common_many(x[short], y[short])
    for k in np.flatnonzero(~short):
        out[known[k]] = _common_letters(x[k], y[k])
    return pd.Series(out)


def lcs_batches(a: Column, b: Column) -> Column:
    """lcs_length over Arrow batches; needs the package on the executors (``session.ship``)."""
    return F.pandas_udf(_common_batch, "int")(a, b)


def sequence_ratio(a: Column, b: Column, common: Column | None = None) -> Column:
    """2 LCS / (|a| + |b|) over normal forms already made; common: the length, if it is known."""
    ratio = 2.0 * (lcs_length(a, b) if common is None else common) / (F.length(a) + F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(ratio)


def name_similarity(a: Column, b: Column, common: Column | None = None) -> Column:
    """Of organisation normal forms: null if either is, 1 if equal, else the kinder of word containment and letter sequence."""
    shared = containment(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    both = a.isNotNull() & b.isNotNull()
    return F.when(~both, None).when((a == "") | (b == ""), 0.0).when((a == b) | (shared >= 1.0), 1.0).otherwise(F.greatest(shared, sequence_ratio(a, b, common)))


def compared_names(a: Column, b: Column) -> Column:
    """name_similarity of raw names, null where either is missing."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), name_similarity(normalise_organisation(a), normalise_organisation(b)))


def compared_text(a: Column, b: Column, measure) -> Column:
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), measure(tokens(a), tokens(b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the signals that could be compared; 0 if none could."""
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w), folded from the heaviest down."""
    return F.aggregate(F.sort_array(weights, False), F.lit(0.0), lambda s, w: s + w * (1 - s))


__all__ = ["jaccard", "containment", "lcs_length", "sequence_ratio", "name_similarity", "compared_names", "compared_text", "haversine_km", "weighted_mean", "noisy_or", "normalise"]
