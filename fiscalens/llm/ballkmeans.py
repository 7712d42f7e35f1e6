"""k-means over whole numbers by balls.

After Xia et al. (2020): a cluster is a ball, its centroid and a radius that no member exceeds. Only centroids within twice the radius are
neighbours. A member closer to its centroid than half the way to the nearest neighbour cannot change (the stable core); the others lie in
annuli between half the ways to one neighbour and the next, and are compared with the neighbours up to there alone. All distances are
squares of whole numbers, so a comparison is exact and ties are ties.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Scaled components stay below it, so that four times a squared distance of some hundred of them is a long.
REACH = 1 << 26
STATE = "vec_id long, raw binary, cluster int, distance long, compared int"


class Balls(NamedTuple):
    """Centroids, and for each the numbers and squared distances of its neighbours, nearest first."""

    centers: np.ndarray
    near: list[np.ndarray]
    gaps: list[np.ndarray]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _whole(width: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False))
            x = np.array(fit.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)  # a null is not a number
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * scale)
            good = (np.abs(x) < REACH).all(1)
            raw = [v.tobytes() for v in x[good].astype("<i4")]
            yield pa.record_batch([fit.column(0).filter(pa.array(good)), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    return run


def whole_vectors(vectors: DataFrame, width: int, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and raw (floor(scale * component) as 32-bit numbers) of the vectors of ``width`` components, none null or non-finite."""
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(_whole(width, scale), "vec_id long, raw binary")


def squares(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = x - center
    return np.einsum("ij,ij->i", d, d)


def _first(centers: np.ndarray):
    """Every vector against every centroid: there are no balls yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), centers.shape[1])
            best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
            for k, c in enumerate(centers):
                d = squares(x, c)
                closer = d < best
                best[closer], at[closer] = d[closer], k
            yield pa.record_batch([*batch.columns[:2], pa.array(at), pa.array(best), pa.array(np.full(len(x), len(centers), np.int32))], names=["vec_id", "raw", "cluster", "distance", "compared"])

    return run


def reassigned(x: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many centroids it was compared with."""
    best, at, compared = np.zeros(len(x), np.int64), cluster.copy(), np.ones(len(x), np.int32)
    for k in np.unique(cluster).tolist():
        rows = np.flatnonzero(cluster == k)
        own = squares(x[rows], balls.centers[k])
        best[rows] = own
        # the annulus: neighbours up to twice a member's distance, 0 of them in the core
        annulus = np.searchsorted(balls.gaps[k], 4 * own, "right")
        compared[rows] += annulus.astype(np.int32)
        for t in range(int(annulus.max())):
            some, j = rows[annulus > t], int(balls.near[k][t])
            d = squares(x[some], balls.centers[j])
            closer = (d < best[some]) | ((d == best[some]) & (j < at[some]))
            best[some[closer]], at[some[closer]] = d[closer], j
    return at, best, compared


def _again(balls: Balls):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best, compared = reassigned(_vectors(batch.column(1), balls.centers.shape[1]), batch.column(2).to_numpy(), balls)
            yield pa.record_batch([*batch.columns[:2], pa.array(at, pa.int32()), pa.array(best), pa.array(compared)], names=["vec_id", "raw", "cluster", "distance", "compared"])

    return run


def _sums(width: int):
    """A row for each cluster that a task has met: rows, componentwise sums, largest squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x, cluster, distance = _vectors(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(cluster).tolist():
                rows = cluster == k
                n, total, far = held.get(k, (0, np.zeros(width, np.int64), 0))
                held[k] = [n + int(rows.sum()), total + x[rows].sum(0), max(far, int(distance[rows].max()))]
        if held:
            sums = np.array([total for _, total, _ in held.values()])
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([n for n, _, _ in held.values()], pa.int64()), pa.array([f for _, _, f in held.values()], pa.int64()), *[pa.array(c) for c in sums.T]], names=["cluster", "n", "far", *[f"s{i}" for i in range(width)]])

    return run


def _moved(state: DataFrame, centers: np.ndarray) -> Balls:
    """The balls around the clusters' means, rounded down; a cluster without members keeps its centroid.

    A radius is bounded by the old one and the way its centroid went, which needs no further look at the members. A row for each cluster
    reaches the driver.
    """
    width = centers.shape[1]
    part = state.select("raw", "cluster", "distance").mapInArrow(_sums(width), f"cluster int, n long, far long, {', '.join(f's{i} long' for i in range(width))}")
    rows = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect()
    new, reach = centers.copy(), np.zeros(len(centers))
    for r in rows:
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
        reach[r.cluster] = math.sqrt(r.far) + math.sqrt(int(squares(new[[r.cluster]], centers[r.cluster])[0]))
    near, gaps = [], []
    for k, c in enumerate(new):
        gap = squares(new, c)
        order = np.lexsort((np.arange(len(new)), gap))
        order = order[(order != k) & (gap[order] <= 4 * (reach[k] + 1) ** 2)]  # 1: more than roots may be off
        near.append(order)
        gaps.append(gap[order])
    return Balls(new, near, gaps)


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids): state has vec_id, raw, cluster, distance (squared) and compared (centroids looked at in the last assignment) of
    every vector kept; the centroids are those that it was assigned to.

    Kept are vectors of ``width`` components, none null or non-finite, nor of a size of REACH or more once scaled (2^20 at a scale of 64),
    whose squared distances would leave the range of a long. The first centroids are the k vectors of smallest sha256 of
    ``seed:vec_id``; rows that share an id, which null ids (as an empty text) also do, come in the order of their components' bytes.
    Equal centroids are allowed; ties go to the smaller number. No vectors kept: no rows and no centroids.
    Vectors never move between tasks: a round reads them twice, once for the sums of the clusters and once to assign, and writes them. The
    driver and each task hold the k centroids and their k * k distances, so k is some thousands at most.
    """
    held = written(whole_vectors(vectors, width, scale), "whole-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = held.select("raw", key.alias("key")).orderBy("key", "raw").limit(k).collect()
    centers = np.frombuffer(b"".join(bytes(r.raw) for r in start), "<i4").reshape(-1, width).astype(np.int64)
    state = written(held.mapInArrow(_first(centers), STATE), "balls")
    for _ in range(rounds if len(centers) else 0):
        balls = _moved(state, centers)
        centers = balls.centers
        state = written(state.select("vec_id", "raw", "cluster").mapInArrow(_again(balls), STATE), "balls")
    return state, centers


def op12(vectors: DataFrame) -> DataFrame:
    """All embeddings that ball_kmeans keeps, in 16 clusters after three rounds: cluster, squared distance, inertia of the cluster and of
    all, and the sha256 of the cluster's centroid. A sum beyond a long is null; repeated rows count each; other columns are not read."""
    state, centers = ball_kmeans(vectors)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    own = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(own.values())
    fits = lambda x: x if x < 1 << 63 else None
    of = state.sparkSession.createDataFrame([(k, fits(n), fits(total), digest[k]) for k, n in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
