"""Centroid clustering of vectors in exact whole numbers, screened in float32.

Vectors become whole numbers floor(scale * x). A round assigns every vector to its nearest centroid and moves every centroid to the floor of its
vectors' mean; all decisions are those of exact arithmetic. Distances of a block of vectors to all centroids are first made by one float32
matrix product, together with an interval that provably holds the true value: for a product of d terms in float32, in any order, with inputs rounded to float32
first, the error is at most gamma(d + 2) * |v| * |c|, gamma(m) = m u / (1 - m u), u = 2^-24. A vector's shortlist holds the centroids whose
interval begins no later than the earliest end of any; where it holds more than one, these are computed again in 64-bit whole numbers, and ties go to the smaller
number.

Spark deals the vectors; a task sends, for each round, a sum and a count for each centroid and component, which are added up by a grouped
aggregate, so what the driver gets and sends back is ``k * components`` numbers, whatever the input, and neither a vector with a third of all rows nor a
cluster with all of them meets in one task. The vectors are written once as whole numbers; each round reads them again.

Edge cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; fewer vectors than ``k`` give as many centroids; equal starting hashes (repeated ids) go by
the vectors' components, then equal vectors start as equal centroids, of which the smaller number gets all; a null id hashes as ``null``; an empty table gives an empty result; whole numbers beyond ``LIMIT``, whose distances might
not fit a long, raise an error that says so; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossbook.llm.arrow import map_batches
from lossbook.llm.store import saved

#: |whole number| below which 64 squared differences add up within a long.
LIMIT = 1 << 27
UNIT = 2.0**-24
#: Vectors screened at a time.
BLOCK = 1 << 13


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 64, scale: float = 256.0) -> DataFrame:
    """key and v, the whole numbers of the rows that count, as an array of long."""
    good = (F.size(vector) == components) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    fits = F.forall("v", lambda x: F.abs(x) < LIMIT)
    rows = df.filter(F.coalesce(good, F.lit(False))).select(F.col(key).alias(key), whole.alias("v"))
    return rows.select(key, F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"components of {LIMIT} and more don't fit")).cast("array<bigint>")).alias("v"))


def _gamma(terms: int) -> float:
    return terms * UNIT / (1 - terms * UNIT)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each vector's nearest centroid in squared Euclidean distance, the smaller number of equally near ones; int64 in, exact."""
    out = np.empty(len(vectors), np.int64)
    squares = (centroids * centroids).sum(axis=1)
    c32, c_norm = centroids.astype(np.float32), np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)
    gamma = _gamma(vectors.shape[1] + 2) * (1 + 1e-9) if vectors.size else 0.0
    for at in range(0, len(vectors), BLOCK):
        v = vectors[at : at + BLOCK]
        v_norm = np.sqrt((v * v).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
        about = squares - 2.0 * (v.astype(np.float32) @ c32.T).astype(np.float64)  # the distance less the vector's own square
        error = 2 * gamma * np.outer(v_norm, c_norm) + 2.0**-50 * (np.abs(about) + squares)
        low, high = about - error, (about + error).min(axis=1)
        short = low <= high[:, None]
        best = short.argmax(axis=1)
        rows = np.flatnonzero(short.sum(axis=1) > 1)
        if len(rows):
            row, k = np.nonzero(short[rows])
            gap = v[rows[row]] - centroids[k]
            exact = (gap * gap).sum(axis=1)
            order = np.lexsort((k, exact, row))
            first = np.ones(len(order), bool)
            first[1:] = row[order][1:] != row[order][:-1]
            best[rows] = k[order][first]
        out[at : at + BLOCK] = best
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _sums(whole: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(centroid, component, exact sum, vectors) of each centroid that is nearest to any vector."""
    k, d = centroids.shape

    def run(batches):
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                cluster = nearest(v, centroids)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], d))],
            names=["cluster", "component", "total", "rows"],
        )

    parts = map_batches(whole.select("v"), run, "cluster long, component long, total long, rows long")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    return [tuple(map(int, r)) for r in parts.groupBy("cluster", "component").agg(exact, F.sum("rows")).collect()]


def _assigned(whole: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    kind = whole.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(1))
            cluster = nearest(v, centroids) if len(v) else np.zeros(0, np.int64)
            gap = v - centroids[cluster] if len(v) else v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array((gap * gap).sum(axis=1))], names=[key, "cluster", "distance"])

    return map_batches(whole.select(key, "v"), run, f"`{key}` {kind}, cluster long, distance long")


def _seed_hash(seed: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 64, scale: float = 256.0, k: int = 40, rounds: int = 5, seed: str = "2"
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance of each vector that counts; the final centroids). k * components numbers are held by the driver and each task."""
    whole = saved(whole_vectors(df, key, vector, components, scale), "whole-vectors")
    start = whole.select("v", _seed_hash(seed, key).alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in sorted(start, key=lambda r: (r.h, r.v))], np.int64).reshape(len(start), components)
    for _ in range(rounds if len(start) else 0):
        moved = centroids.copy()
        for cluster, component, total, rows in _sums(whole, centroids):
            moved[cluster, component] = total // rows
        centroids = moved
    if not len(start):
        return whole.select(key, F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    return saved(_assigned(whole, key, centroids), "assigned-vectors"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with cluster_inertia, inertia and centroid_sha256; the table that is broadcast has a row for each centroid."""
    spark = assigned.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {int(r[0]): int(r[1]) for r in assigned.groupBy("cluster").agg(total).collect()}
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(rows, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster")


def oracle_sql(components: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> str:
    """The query in SQL: one pair of steps for each round."""
    square = f"list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, {components + 1})])::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {components} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {components})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT row_id, vec_id, v, k, {square} AS distance FROM v, c{n})")
        steps.append(f"a{n} AS MATERIALIZED (SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(distance) AS distance, arg_min(k, distance * {k} + k) AS k FROM d{n} GROUP BY row_id)")
        if n < rounds:
            sums = f"SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, {components + 1}) t(i) GROUP BY k, i"
            steps.append(f"m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY k)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))")
    return f"""
WITH {", ".join(steps)}
SELECT a.vec_id, a.k::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)
"""
