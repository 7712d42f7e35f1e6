"""Near copies among embeddings by an epsilon grid order join.

After Böhm et al. (2001): unit vectors are sorted by their grid cells on the leading principal dimensions, cut into intervals of that
order, and pairs of intervals are joined recursively; a pair whose boxes lie more than epsilon apart is skipped, which is safe, as
distance in some dimensions bounds the whole distance. A cosine of c is a distance of sqrt(2 - 2c).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .textkernel import by_group

#: Vectors of a leaf of the recursion, and of an interval (a task joins a pair of intervals).
LEAF, INTERVAL = 512, 8192


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width) if len(column) else np.zeros((0, width))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row by row the vector as bytes of doubles, null if it links with nothing, and its width."""
    for batch in batches:
        raw, width = [], []
        for v in batch.column(1):
            x = np.array(v.values.to_numpy(zero_copy_only=False), float) if v.is_valid and len(v) and not v.values.null_count else np.zeros(0)
            good = len(x) and np.isfinite(x).all() and x.any()
            raw.append(x.astype("<f8").tobytes() if good else None)
            width.append(len(x))
        yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "raw", "width"])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square leaves the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        widths = batch.column(1).to_numpy()
        for w in np.unique(widths).tolist():
            x = unit(_matrix(batch.column(0).filter(pa.array(widths == w)), w))
            part = [len(x), x.sum(0), x.T @ x]
            total[w] = [a + b for a, b in zip(total[w], part, strict=True)] if w in total else part
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([n for n, _, _ in total.values()], pa.int64()), pa.array([s.tobytes() + g.tobytes() for _, s, g in total.values()], pa.binary())], names=["width", "n", "sums"])


def _together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of one width and group of tasks as one row."""
    total = np.zeros(0)
    for x in pdf["sums"]:
        total = np.frombuffer(x) if not len(total) else total + np.frombuffer(x)
    return pd.DataFrame({"width": [key[0]], "task": [key[1]], "n": [pdf["n"].sum()], "sums": [total.tobytes()]})


def principal(vectors: DataFrame, dims: int, fan_in: int = 32, levels: int = 4) -> dict[int, np.ndarray]:
    """For each width the leading principal dimensions of its unit vectors (rows), from sums that every task makes of all its rows.

    The tasks' sums are added ``fan_in`` at a time in ``levels`` rounds of grouping; one row a width reaches the driver.
    """
    sums = vectors.select("raw", "width").mapInArrow(_moments, "width int, n long, sums binary").withColumn("task", F.spark_partition_id())
    for level in range(levels):
        group = F.floor(F.col("task") / fan_in).cast("int") if level < levels - 1 else F.lit(0)
        sums = sums.withColumn("task", group).groupBy("width", "task").applyInPandas(_together, "width int, task int, n long, sums binary")
    out = {}
    for r in sums.collect():
        w, a = r.width, np.frombuffer(r.sums) / r.n
        s, g = a[:w], a[w:].reshape(w, w)
        out[w] = np.ascontiguousarray(np.linalg.eigh(g - np.outer(s, s))[1][:, ::-1].T[: min(dims, w)])
    return out


def _ordered(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            cells = [b""] * batch.num_rows
            for w in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == w)
                p = unit(_matrix(batch.column(1).take(pa.array(rows)), w)) @ axes[w].T
                key = (np.floor(p / epsilon) + (1 << 15)).astype(">u2")
                fine = (p[:, :1] * 1e6 + (1 << 31)).astype(">u4")
                for i, row, f in zip(rows.tolist(), key, fine, strict=True):
                    cells[i] = row.tobytes() + f.tobytes()
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, "cell"])

    return run


def _link(a: np.ndarray, b: np.ndarray, x: np.ndarray, fine: np.ndarray, p: np.ndarray, threshold: float, epsilon: float, found) -> None:
    """Pairs of rows a[i], b[j] (a is b: i < j) with a cosine of the threshold, by halving; found gets their row numbers."""
    gap = np.maximum(0, np.maximum(p[a].min(0) - p[b].max(0), p[b].min(0) - p[a].max(0)))
    if a is not b and gap @ gap > epsilon * epsilon:
        return
    if len(a) > LEAF or len(b) > LEAF:
        if a is b:
            lo, hi = a[: len(a) // 2], a[len(a) // 2 :]
            for u, v in ((lo, lo), (lo, hi), (hi, hi)):
                _link(u, v, x, fine, p, threshold, epsilon, found)
        elif len(a) >= len(b):
            for u in (a[: len(a) // 2], a[len(a) // 2 :]):
                _link(u, b, x, fine, p, threshold, epsilon, found)
        else:
            for v in (b[: len(b) // 2], b[len(b) // 2 :]):
                _link(a, v, x, fine, p, threshold, epsilon, found)
        return
    s = x[a] @ x[b].T
    slack = max(1e-5, 4e-7 * x.shape[1])
    hit = np.flatnonzero(s.ravel() >= threshold - slack)
    if a is b:
        hit = hit[hit // len(b) < hit % len(b)]
    if not len(hit):
        return
    i, j = a[hit // len(b)], b[hit % len(b)]
    near = np.flatnonzero(np.abs(s.ravel()[hit] - threshold) <= slack)  # single precision cannot tell
    keep = np.ones(len(hit), bool)
    for lo in range(0, len(near), 1 << 14):
        k = near[lo : lo + (1 << 14)]
        u, v = fine[i[k]], fine[j[k]]
        keep[k] = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= threshold
    found(i[keep], j[keep])


def _join(axes: dict[int, np.ndarray], threshold: float, epsilon: float):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        width = table.column("width")[0].as_py()
        side, single = table.column("interval").to_numpy(), table.column("_single")[0].as_py()
        raw = _matrix(table.column("raw"), width)
        fine = raw / np.abs(raw).max(1, keepdims=True)
        one = unit(raw)
        p, x = one @ axes[width].T, one.astype(np.float32)
        cell = table.column("cell").to_pylist()
        order = np.array(sorted(range(len(cell)), key=cell.__getitem__), np.int64)
        a = order[side[order] == side.min()]
        b = a if single else order[side[order] == side.max()]
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        links, label = np.zeros(len(rid), np.int64), np.arange(len(rid))

        def found(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while True:
                u, v = label[i], label[j]
                apart = u != v
                if not apart.any():
                    return
                i, j, u, v = i[apart], j[apart], u[apart], v[apart]
                np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
                while (label[label] != label).any():
                    label[:] = label[label]

        _link(a, b, x, fine, p, threshold, epsilon + 1e-6, found)
        some, star = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rid)))
        if not len(some):
            return None
        return pa.record_batch([pa.array(np.concatenate([rid[some], rid[star]])), pa.array([None] * len(some) + rid[label[star]].tolist(), pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(star), np.int64)]))], names=["a", "b", "links"])

    return work


def interval_pairs(boxes: DataFrame, dims: int, epsilon: float) -> DataFrame:
    """boxes (width, interval, lo, hi: arrays; a row an interval) as pairs (width, u, v: u <= v) whose boxes lie within epsilon.

    Intervals are the leaves of a binary tree over their order. Pairs of nodes are refined level by level from the root, and a pair whose
    boxes are too far apart is skipped with all pairs below it, so that no product of all intervals is made.
    """
    top = (boxes.agg(F.max("interval")).first()[0] or 0).bit_length()
    levels = [boxes.select("width", F.col("interval").alias("node"), "lo", "hi")]
    for _ in range(top):
        below = levels[-1]
        merged = [F.min(F.col("lo")[k]).alias(f"l{k}") for k in range(dims)] + [F.max(F.col("hi")[k]).alias(f"h{k}") for k in range(dims)]
        levels.append(below.groupBy("width", F.shiftright("node", 1).alias("node")).agg(*merged).select("width", "node", F.array(*[f"l{k}" for k in range(dims)]).alias("lo"), F.array(*[f"h{k}" for k in range(dims)]).alias("hi")))
    pairs = levels[-1].select("width", F.col("node").alias("u"), F.col("node").alias("v"))
    for level in reversed(levels[:-1] or levels):
        if top:
            half = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y")), F.struct(F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.lit(1).alias("x"), F.lit(1).alias("y")))
            pairs = pairs.withColumn("_h", F.explode(half)).select("width", (F.col("u") * 2 + F.col("_h.x")).alias("u"), (F.col("v") * 2 + F.col("_h.y")).alias("v")).where("u <= v")
        left = level.select("width", F.col("node").alias("u"), F.col("lo").alias("_ulo"), F.col("hi").alias("_uhi"))
        right = level.select("width", F.col("node").alias("v"), F.col("lo").alias("_vlo"), F.col("hi").alias("_vhi"))
        gaps = [F.greatest(F.lit(0.0), F.col("_ulo")[k] - F.col("_vhi")[k], F.col("_vlo")[k] - F.col("_uhi")[k]) for k in range(dims)]
        apart = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
        pairs = written(pairs.join(left, ["width", "u"]).join(right, ["width", "v"]).where(apart <= epsilon * epsilon + 1e-6).select("width", "u", "v"), "ego-pairs")
    return pairs


def near_vectors(vectors: DataFrame, threshold: float = 0.9, dims: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other rows with a cosine of the threshold or more), component_id (smallest vec_id
    reachable by links), kept (whether that is the row itself).

    Null, empty and zero vectors and those with null or non-finite components link with nothing; nor do vectors of different length.
    Equal vectors are one node with a count. A null vec_id comes before all others. The sort deals vectors over tasks by sampled
    bounds; an interval has up to INTERVAL vectors, a task joins two. Where data have no structure in the leading dimensions few pairs
    can be skipped, and the work is that of all pairs of intervals, in dense products.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = written(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(_usable, "vec_id long, raw binary, width int").withColumn("fp", F.when(F.col("raw").isNotNull(), F.unhex(F.md5("raw")))), "vectors")
    nodes = rows.where("raw is not null").groupBy("fp").agg(F.min(F.struct(F.col("vec_id").isNotNull(), F.col("vec_id")))["vec_id"].alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"), F.first("width").alias("width"))
    nodes = written(nodes.withColumn("rid", F.monotonically_increasing_id()), "vector-nodes")
    axes = principal(nodes, dims)
    placed = nodes.select("rid", "raw", "width", "copies").mapInArrow(_ordered(axes, epsilon), "rid long, raw binary, width int, copies long, cell binary")
    dealt = placed.repartitionByRange("width", "cell", "rid").sortWithinPartitions("width", "cell", "rid").withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = written(dealt, "ego-order")
    # rows are counted through over the tasks of one width, from the tasks' counts, and every INTERVAL of them are an interval
    count = dealt.groupBy("width", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    line = Window.partitionBy("width").orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    total = count.withColumn("_before", F.sum("_n").over(line) - F.col("_n")).select("width", "_task", "_from", "_before")
    ordered = dealt.join(total, ["width", "_task"]).withColumn("interval", F.floor((F.col("_before") + F.col("_at") - F.col("_from")) / INTERVAL).cast("long"))
    ordered = written(ordered.select("rid", "raw", "width", "copies", "cell", "interval"), "ego-intervals")

    k = max((len(a) for a in axes.values()), default=1)
    boxes = ordered.select("width", "interval", "raw").mapInArrow(_boxes(axes, k), f"width int, interval long, {', '.join(f'l{i} double, h{i} double' for i in range(k))}")
    boxes = boxes.groupBy("width", "interval").agg(*[F.min(f"l{i}").alias(f"l{i}") for i in range(k)], *[F.max(f"h{i}").alias(f"h{i}") for i in range(k)])
    boxes = written(boxes.select("width", "interval", F.array(*[f"l{i}" for i in range(k)]).alias("lo"), F.array(*[f"h{i}" for i in range(k)]).alias("hi")), "ego-boxes")
    pairs = interval_pairs(boxes, k, epsilon)
    sides = pairs.select("width", F.col("u").alias("interval"), "u", "v").union(pairs.where("u <> v").select("width", F.col("v").alias("interval"), "u", "v"))
    cells = ordered.join(sides, ["width", "interval"]).select("rid", "raw", "width", "copies", "cell", "interval", (F.col("u") == F.col("v")).alias("_single"), F.xxhash64("width", "u", "v").alias("_cell"))
    found = written(cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(by_group("_cell", _join(axes, threshold, epsilon)), "a long, b long, links long"), "ego-links")

    links = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("_links"))
    labels = components(found.where("b is not null")).select(F.col("node").alias("rid"), "label")
    known = nodes.select("rid", "fp", "copies", "least_id").join(links, "rid", "left").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    low = known.groupBy("label").agg(F.min(F.struct(F.col("least_id").isNotNull(), F.col("least_id"))).alias("_low"))
    known = written(known.join(low, "label").select("fp", "copies", F.coalesce("_links", F.lit(0).cast("long")).alias("_links"), F.col("_low.least_id").alias("component_id")), "vectors-known")
    some = F.col("fp").isNotNull()
    return rows.select("vec_id", "fp").join(known, "fp", "left").select(
        "vec_id", F.when(some, F.col("copies") - 1 + F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(some, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(some, F.col("vec_id").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("kept"))


def _boxes(axes: dict[int, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, interval = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = []
            for w, i in sorted(set(zip(widths.tolist(), interval.tolist(), strict=True))):
                p = unit(_matrix(batch.column(2).filter(pa.array((widths == w) & (interval == i))), w)) @ axes[w].T
                lo, hi = p.min(0).tolist(), p.max(0).tolist()
                box = [x for d in range(k) for x in ((lo[d], hi[d]) if d < len(lo) else (0.0, 0.0))]
                rows.append([w, i, *box])
            if rows:
                kinds = [pa.int32(), pa.int64(), *[pa.float64()] * (2 * k)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["width", "interval", *[f"{x}{d}" for d in range(k) for x in "lh"]])

    return run


def op5(vectors: DataFrame) -> DataFrame:
    """All embeddings by cosine in double precision, 0.9 or more: vec_id, n_links, component_id, kept, a row for each row of vectors.

    Repeated rows are vectors of their own and link with each other; other columns are not read; an empty table gives no rows.
    """
    return near_vectors(vectors)
