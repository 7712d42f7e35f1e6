"""Connected components of links too many for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as stars around each local component's smallest node."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        found = [(x, y) for x in list(root) if (y := find(x)) != x]
        if found:
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b: long) as node, label: the smallest node of its component. Nodes without links are absent.

    Each round every node takes its smallest neighbour's label, labels are followed once more, and links contract to their labels;
    links between equal labels go. Components at least halve in a round. A node's links meet only in a minimum, which tasks combine
    before the shuffle, and in joins, which Spark splits; no component is gathered anywhere.
    """
    links = written(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"), "links")
    labels = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        least = written(least, "least")
        further = least.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        least = written(least.join(further, "label").select("node", F.col("_next").alias("label")), "labels")
        if labels is None:
            labels = least
        else:
            now = least.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            labels = written(labels.join(now, "label", "left").select("node", F.coalesce("_next", "label").alias("label")), "labels")
        ends = least.select(F.col("node"), F.col("label"))
        links = links.join(ends.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a").join(ends.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
        links = written(links.where("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")
