"""Names near to each other: a bound from their characters, packed and compared in blocks, before any two are aligned."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of either side that meet in one cell, about, and of which so many are compared at once.
CELL_A, CELL_B, AT_ONCE = 2048, 4096, 256


def signatures(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(how often each name has each byte that any of them has: a row a byte, lengths). Names are ASCII."""
    raw = [n.encode("ascii", "replace") for n in names]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat, owner = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.repeat(np.arange(len(raw)), size)
    counts = np.bincount(flat * len(raw) + owner, minlength=128 * len(raw)).reshape(128, len(raw))
    return counts.astype(np.uint8 if int(size.max(initial=0)) < 128 else np.uint32), size


def survivors(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of names whose characters, in any order, allow a ratio of the threshold: twice what they share over their lengths."""
    x, la = signatures(a)
    y, lb = signatures(b)
    some = np.flatnonzero(x.any(1) & y.any(1))
    found = []
    for lo in range(0, len(a), AT_ONCE):
        hi = min(len(a), lo + AT_ONCE)
        shared = np.zeros((hi - lo, len(b)), np.promote_types(x.dtype, y.dtype))
        for c in some.tolist():
            shared += np.minimum(x[c, lo:hi, None], y[c, None, :])
        i, j = np.nonzero(2.0 * shared >= (threshold - 1e-9) * (la[lo:hi, None] + lb[None, :]))
        found.append((i + lo, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _aligned(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        left = table.column("_left").combine_chunks()
        a, b = table.filter(left).column("name").to_pylist(), table.filter(pa.compute.invert(left)).column("name").to_pylist()
        out: list[tuple[str, str, float]] = []
        if a and b:
            matcher = difflib.SequenceMatcher(None)
            i, j = survivors(a, b, threshold)
            at = None
            for k in np.lexsort((i, j)).tolist():
                if j[k] != at:  # what the matcher learns of its second name serves all first ones
                    at = j[k]
                    matcher.set_seq2(b[at])
                x = a[i[k]]
                matcher.set_seq1(x)
                ratio = 1.0 if x == b[at] else matcher.ratio()
                if ratio >= threshold:
                    out.append((x, b[at], ratio))
        return pa.table({"a": pa.array([r[0] for r in out], pa.string()), "b": pa.array([r[1] for r in out], pa.string()), "similarity": pa.array([r[2] for r in out], pa.float64())})

    return work


def near_names(a: DataFrame, b: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs (a, b, similarity) of normalised names, each once, whose ratio of matching blocks reaches the threshold; none is lost. Each table has one
    column; null and empty names are near to none.

    Names meet by the length of b's: a name goes to all lengths that its own allows, and a length of many names falls into cells. In a
    cell every pair's characters are counted together in vectorised steps; only pairs whose characters allow the threshold are aligned.
    """
    a, b = (df.select(F.col(df.columns[0]).alias("name")).where(F.col("name") != "").distinct() for df in (a, b))
    b = b.withColumn("_length", F.length("name"))
    reach = threshold / (2 - threshold)  # of lengths that a ratio of the threshold allows
    n = F.length("name")
    a = a.withColumn("_length", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(n * reach).cast("int")), F.floor(n / reach).cast("int") + 1)))
    of = lambda df, cell, name: df.groupBy("_length").agg(F.ceil(F.count(F.lit(1)) / cell).cast("long").alias(name))
    sizes = of(a, CELL_A, "_i").join(of(b, CELL_B, "_j"), "_length")

    def side(df: DataFrame, own: str, other: str, left: bool) -> DataFrame:
        p, q = F.pmod(F.xxhash64("name"), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        dealt = df.join(sizes, "_length").select("name", "_length", p.alias("_p"), q.alias("_q"))
        return dealt.select("name", "_length", F.lit(left).alias("_left"), *(("_p", "_q") if left else (F.col("_q").alias("_p"), F.col("_p").alias("_q"))))

    met = side(a, "_i", "_j", True).unionByName(side(b, "_j", "_i", False))
    return met.groupBy("_length", "_p", "_q").applyInArrow(_aligned(threshold), "a string, b string, similarity double")
