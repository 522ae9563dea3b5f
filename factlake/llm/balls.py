"""Ball k-means over whole-number vectors: each cluster is a ball, only balls that touch are neighbours, and a member is compared with
those neighbours alone whose bisecting plane its distance can reach."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256.0
#: Components saturate here, so that a squared distance of up to 64 of them fits 64 bits.
MOST = 1 << 27
#: Components up to which a sum of 2**7 products is exact in doubles; larger ones are summed as 64-bit integers.
EXACT = 1 << 22


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(vec_id long, vec binary) of the vectors of exactly dim components, none null or non-finite: floor(scale x component) as little-endian
    32-bit integers."""
    v = F.col(vec_col).cast("array<double>")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            q = np.floor(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim) * scale)
            q = np.clip(q, -MOST, MOST).astype("<i4")
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(q), [None, pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed.cast(pa.binary())], names=["vec_id", "vec"])

    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).mapInArrow(run, "vec_id long, vec binary")


def integers(vecs: pa.Array, dim: int) -> np.ndarray:
    _, offsets, data = vecs.buffers()
    if not len(vecs):
        return np.empty((0, dim), np.int64)
    lo = int(np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(vecs.type) else np.int32)[vecs.offset])
    return np.frombuffer(data, "<i4", count=dim * len(vecs), offset=lo).reshape(-1, dim).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c, one vector or a row for each."""
    d = x - c
    if x.size and max(int(np.abs(x).max()), int(np.abs(c).max())) <= EXACT:
        f = d.astype(np.float64)
        return np.einsum("ij,ij->i", f, f).astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


class Balls:
    """Centroids and, of each, the neighbours whose ball its own may touch, nearest first. radius2: squared distance of each cluster's
    farthest member from the centroid before; moved, that one is still a bound of the ball's radius."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray, radius2: list[int]):
        k = len(centroids)
        self.centroids, self.near, self.gap = centroids, [], []
        for i in range(k):
            gap = squared(centroids, centroids[i])
            moved = int(squared(before[i : i + 1], centroids[i])[0])
            radius = isqrt(radius2[i]) + isqrt(moved) + 2
            touch = np.flatnonzero((gap <= min(4 * radius * radius, (1 << 63) - 1)) & (np.arange(k) != i))
            touch = touch[np.lexsort((touch, gap[touch]))]
            self.near.append(touch)
            self.gap.append(gap[touch])

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New cluster and squared distance of each row of x that was in cluster own, and how many distances it took. A member nearer to
        its centroid than half the way to the nearest neighbour is in the stable core and stays; the others lie in annuli, and one
        of the k-th annulus is compared with its first k neighbours. Of equal distances the smaller cluster wins."""
        best, took = own.copy(), len(x)
        dist = squared(x, self.centroids[own])
        for i in np.unique(own):
            at = np.flatnonzero(own == i)
            annulus = np.searchsorted(self.gap[i], 4 * dist[at], "right")  # on the plane itself a tie is possible
            for k, j in enumerate(self.near[i]):
                at, annulus = at[annulus > k], annulus[annulus > k]
                if not len(at):
                    break
                d = squared(x[at], self.centroids[j])
                took += len(at)
                nearer = (d < dist[at]) | ((d == dist[at]) & (j < best[at]))
                best[at[nearer]], dist[at[nearer]] = j, d[nearer]
        return best, dist, took


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first assignment, when there are no balls yet."""
    best, dist = np.zeros(len(x), np.int64), squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < dist
        best[nearer], dist[nearer] = j, d[nearer]
    return best, dist


def _assigned(rows: DataFrame, centroids: np.ndarray, balls: Balls | None, dim: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            x = integers(batch.column(1), dim)
            if balls is None:
                best, dist = nearest(x, centroids)
            else:
                best, dist, _ = balls.assign(x, batch.column(2).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(dist)], names=["vec_id", "vec", "cluster", "distance"])

    rows = rows if balls is None else rows.select("vec_id", "vec", "cluster")
    return materialize(rows.mapInArrow(run, "vec_id long, vec binary, cluster int, distance long"), "balls-rows")


def _sums(rows: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """Of each cluster the sums of its members' components, their number, farthest and summed squared distance. Each batch sends a row
    for each cluster and component; at most k x (dim + 2) rows reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            x, own, dist = integers(batch.column(0), dim), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(own, kind="stable")
            found, first = np.unique(own[order], return_index=True)
            if not len(found):
                continue
            total = np.add.reduceat(x[order], first, axis=0)
            n = np.diff(np.append(first, len(own)))
            more = np.stack([n, np.add.reduceat(dist[order] >> 31, first), np.add.reduceat(dist[order] & ((1 << 31) - 1), first)], axis=1)
            value = np.concatenate([total, more], axis=1)
            far = np.zeros_like(value)
            far[:, dim] = np.maximum.reduceat(dist[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found, dim + 3), pa.int32()), pa.array(np.tile(np.arange(dim + 3), len(found)), pa.int32()), pa.array(value.ravel()), pa.array(far.ravel())], names=["cluster", "at", "value", "far"])

    parts = rows.select("vec", "cluster", "distance").mapInArrow(run, "cluster int, at int, value long, far long")
    total, far = [[0] * (dim + 3) for _ in range(k)], [0] * k
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.max("far").alias("far")).collect():
        total[r.cluster][r.at] = int(r.value)
        far[r.cluster] = max(far[r.cluster], r.far)
    return [t[:dim] for t in total], [t[dim] for t in total], far, [(t[dim + 1] << 31) + t[dim + 2] for t in total]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, dim: int = DIM, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, vec, cluster, distance) of each kept vector, the k final centroids, and each cluster's summed squared distance.

    The centroids start as the vectors of the smallest SHA-256 of `seed:id`. Each round assigns all vectors and replaces each centroid that
    has members by the floor of their mean; then vectors are assigned once more. All of it is exact in whole numbers, so neither
    order nor partitioning changes a row. A round reads and writes each vector once, in place, and shuffles sums alone; k x dim sums,
    the centroids and their k x k distances are what the driver and each task hold. Rows that a round wrote are deleted when the next stand."""
    rows = materialize(quantised(vectors, id_col, vec_col, dim, scale), "balls-vectors")
    named = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("h", "vec").limit(k).collect()
    if not first:
        discard(rows)
        return rows.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.empty((0, dim), np.int64), []
    centroids = np.stack([np.frombuffer(r.vec, "<i4").astype(np.int64) for r in first])
    balls = None
    for r in range(rounds + 1):
        now = _assigned(rows, centroids, balls, dim)
        discard(rows)
        rows = now
        total, n, far, inertia = _sums(rows, len(centroids), dim)
        if r < rounds:
            moved = np.array([[s // m for s in t] if m else c.tolist() for t, m, c in zip(total, n, centroids)], np.int64)
            balls, centroids = Balls(moved, centroids, far), moved
    return rows, centroids, inertia


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, dim: int = DIM, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia (distances summed over
    its cluster and over all), centroid_sha256 (of the centroid's components as decimal numbers joined by commas).

    Null vectors, those of another length, and those with a null or non-finite component are left out. A vector with a null id is
    clustered but starts no centroid. Repeated rows stay repeated; equal centroids leave all members to the smaller number. With fewer than
    k vectors with an id there are as many centroids; with none, or an empty table, no rows. Components beyond 2**27 in size saturate.
    Other columns aren't read."""
    rows, centroids, inertia = cluster(vectors, k, rounds, seed, dim, scale, id_col, vec_col)
    most = (1 << 63) - 1
    facts = [(i, min(x, most), min(sum(inertia), most), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, (c, x) in enumerate(zip(centroids, inertia))]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2, dim: int = DIM, scale: float = SCALE) -> str:
    """DuckDB SQL of cluster_vectors over embeddings: all distances, every round."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor({scale!r}::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        "e AS MATERIALIZED (SELECT u, unnest(q) AS x, unnest(range(len(q))) AS i FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(q) AS x, unnest(range(len(q))) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS k, q FROM v WHERE vec_id IS NOT NULL) WHERE k < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT u, d[2] AS k, d[1] AS d FROM (SELECT u, min([d, k]) AS d FROM (SELECT u, k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c ON e.i = c.i GROUP BY u, k) GROUP BY u))")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x, c.i FROM c{r} c LEFT JOIN (SELECT k, i, CAST((s - ((s % n + n) % n)) // n AS BIGINT) AS x FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN e USING (u) GROUP BY k, i)) m ON m.k = c.k AND m.i = c.i)")
    return f"""WITH {', '.join(parts)}, h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256 FROM a{rounds} JOIN v USING (u) JOIN h USING (k)"""
