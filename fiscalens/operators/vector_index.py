"""A stored index of vectors for exact nearest neighbours by cosine: cells around pivots with their radii, skipped by the triangle inequality
of angles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.storage import new_folder

#: What rounding may take off an angle.
SLACK = 1e-7


class Found(NamedTuple):
    """rows: vec_id, similarity, best first. cells, read: how many cells there are, and how many were looked into."""

    rows: DataFrame
    cells: int
    read: int


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _placed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1))
            s = x @ pivots.T
            cell = s.argmax(1)
            angle = np.arccos(np.clip(s[np.arange(len(x)), cell], -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["vec_id", "embedding", "cell", "angle"])

    return run


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, most_cells: int = 1024) -> str:
    """The folder of an index of vectors (vec_id, embedding: all of one length). Null, empty and zero vectors are near to nothing and are left out.

    Pivots are ``cells`` of the vectors (by default the root of their number, ``most_cells`` at most), chosen by a hash, which driver and tasks
    hold; every vector goes to its nearest pivot's cell. Vectors lie in files by cell and angle to the pivot, so that a search skips the files
    and row groups of other cells and angles.
    """
    spark = vectors.sparkSession
    path = path or new_folder(spark, "vector-index")
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda v: v != 0))
    kind = dict(x.dtypes)["vec_id"]
    cells = cells or min(most_cells, max(1, math.isqrt(x.count())))
    chosen = x.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(cells).collect()
    pivots = _unit(np.array([r.embedding for r in chosen], float)) if chosen else np.zeros((1, 1))
    placed = x.mapInArrow(_placed(pivots), f"vec_id {kind}, embedding array<double>, cell int, angle double")
    placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.parquet(f"{path}/vectors")
    bounds = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.min("angle").alias("nearest"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")
    bounds.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/cells")
    return path


def search(spark: SparkSession, path: str, query: list[float], top_k: int = 10, step: int = 8) -> Found:
    """The ``top_k`` vectors with the largest positive cosine to the query, as a scan of all would give them.

    A vector's angle to the query is at least the difference of both angles to its pivot. Cells are read ``step`` and then twice as many at a
    time, in order of the least angle that they can hold, until no cell left can hold one of the best; in a cell only the angles are read that can.
    """
    q = _unit(np.array(query, float))
    to = {r.cell: (float(np.arccos(np.clip(np.array(r.pivot) @ q, -1, 1))), r.nearest, r.radius) for r in spark.read.parquet(f"{path}/cells").collect()}
    least = sorted((max(0.0, a - radius, nearest - a), cell) for cell, (a, nearest, radius) in to.items())
    schema = spark.read.parquet(f"{path}/vectors").schema
    # F.aggregate over the stored vector; the same sum as a scan makes
    parts = F.array(*[F.lit(float(v)) for v in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("embedding"), parts) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(parts, parts)))))
    best: list[tuple[float, object]] = []
    edge, done = math.pi / 2, 0  # a cosine of 0 is near to nothing
    while done < len(least) and least[done][0] <= edge + SLACK:
        some = [cell for bound, cell in least[done : done + step] if bound <= edge + SLACK]
        near = F.lit(False)
        for cell in some:
            near |= (F.col("cell") == cell) & F.col("angle").between(to[cell][0] - edge - SLACK, to[cell][0] + edge + SLACK)
        rows = spark.read.schema(schema).parquet(f"{path}/vectors").where(F.col("cell").isin(some) & near).select("vec_id", cosine.alias("_s")).where("_s > 0")
        rows = rows.select("vec_id", rounded(F.col("_s"), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(top_k).collect()
        best = sorted([*best, *((-r.similarity, r.vec_id) for r in rows)])[:top_k]
        if len(best) == top_k:
            edge = min(edge, math.acos(max(-1.0, min(1.0, -best[-1][0] - 1e-6))))  # what rounds to the last one's similarity still counts
        done, step = done + len(some), step * 2
        if not some:
            break
    kind = schema["vec_id"].dataType.simpleString()
    return Found(spark.createDataFrame([(i, -s) for s, i in best], f"vec_id {kind}, similarity double"), len(least), done)
