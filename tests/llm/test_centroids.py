"""Clustering against Python's whole numbers, and the screening's intervals."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from lossbook.llm import centroids


def brute(rows, k, rounds, components, scale=256.0, seed="2"):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == components and all(c is not None and math.isfinite(c) for c in x):
            kept.append((key, [math.floor(scale * float(c)) for c in x]))
    hashed = sorted((hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest(), v) for key, v in kept)
    c = [v for _, v in hashed[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else w for g, w in zip(groups, c, strict=True)]
    return [(key, near(v)[1], near(v)[0]) for key, v in kept], c


@pytest.mark.parametrize("size", [3, 300, 60_000_000])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size, (30, 64))
    c[7], c[20] = c[3], c[3] + (np.arange(64) == 5)
    v = np.concatenate([rng.integers(-size, size, (300, 64)), c, (c[3] + c[20])[None] // 2, c[:29] + (c[1:] - c[:29]) // 2, np.zeros((1, 64), np.int64)])
    gap = v[:, None, :] - c[None]
    assert (centroids.nearest(v, c) == (gap * gap).sum(axis=2).argmin(axis=1)).all()


def test_screening_never_loses_the_nearest(monkeypatch):
    """Vectors a hair apart around a far centre, where float32 alone goes wrong."""
    rng = np.random.default_rng(1)
    centre = rng.integers(100_000_000, 120_000_000, 64)
    c = centre + rng.integers(-2, 3, (40, 64))
    v = centre + rng.integers(-2, 3, (500, 64))
    gap = v[:, None, :] - c[None]
    exact = (gap * gap).sum(axis=2)
    f32 = (c.astype(np.float32) ** 2).sum(axis=1) - 2 * (v.astype(np.float32) @ c.astype(np.float32).T)
    assert (f32.argmin(axis=1) != exact.argmin(axis=1)).any()
    monkeypatch.setattr(centroids, "BLOCK", 64)
    assert (centroids.nearest(v, c) == exact.argmin(axis=1)).all()


def test_clusters_by_brute_force(spark):
    rng = random.Random(6)
    middles = [[rng.gauss(0, 0.3) for _ in range(4)] for _ in range(5)]
    rows = [(i, [rng.gauss(m, 0.05) for m in middles[i % 5]]) for i in range(300)]
    rows += [(i, [0.25, 0.25, -0.25, 0.0]) for i in range(300, 420)]  # a vector of many rows, on ties
    rows += [(500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0, 3.0]), (504, [1.0, float("nan"), 2.0, 3.0]), (505, [float("-inf"), 1.0, 2.0, 3.0])]
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (7, rows[7][1]), (7, [9.0, -9.0, 9.0, -9.0]), (600, [-0.001, 1e-9, -1e-9, 0.0])]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    got, c = centroids.cluster_vectors(frame, components=4, k=9, rounds=4)
    want, want_c = brute(rows, 9, 4, 4)
    assert c.tolist() == want_c
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    full = centroids.with_inertia(got, c).collect()
    assert len(full) == len(want)
    for r in full:
        assert r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_c[r.cluster])).encode()).hexdigest()


def test_few_none_and_too_large(spark):
    kind = "vec_id long, embedding array<float>"
    got, c = centroids.cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], kind), components=2)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0)] and c.tolist() == [[256, 512]]
    got, c = centroids.cluster_vectors(spark.createDataFrame([], kind), components=2)
    assert centroids.with_inertia(got, c).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], kind), components=2)
