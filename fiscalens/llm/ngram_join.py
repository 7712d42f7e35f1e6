"""Jaccard join on word shingles: MinHash bands find candidates, a Bayesian test prunes them, exact sets verify the rest.

After BayesLSH (Satuluri and Parthasarathy, 2012): hashes are compared in steps, and a pair goes as soon as the posterior probability
that its similarity reaches the threshold, under a uniform prior, falls below a tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shielded, written
from .textkernel import by_group, flat, pieces, shingles, word_hashes, words

BANDS, ROWS, STEP = 25, 5, 25
HASHES = BANDS * ROWS
#: Documents of one cell of a group's comparison, and bytes of text of one side.
SIDE, SIDE_BYTES = 256, 16 << 20


def _family(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(seed))
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(values: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """MinHashes of each text's shingles (texts without any: zeros)."""
    factor, shift = _family(seed)
    out = np.zeros((len(at) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(at))
    low = (values >> np.uint64(32)).astype(np.uint32)
    if len(some):
        for i in range(HASHES):
            out[some, i] = np.minimum.reduceat(low * factor[i] + shift[i], at[some])
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 25, 50, ... hashes compared: the fewest that must match. The posterior of similarity s after m matches of n is
    Beta(m + 1, n - m + 1), so that P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def pruned(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of signature rows that the test keeps."""
    have = np.zeros(len(i), np.int32)
    for step, most in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        have = have + (left[i, cut] == right[j, cut]).sum(1, dtype=np.int32)
        keep = have >= most
        i, j, have = i[keep], j[keep], have[keep]
    return i, j


def _sketch(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                data, at = flat(part.column(2))
                start, end, first = words(data, at)
                values, runs = shingles(word_hashes(data, start, end), first, width, short=True)
                sig = signatures(values, runs, seed)
                rows = [s.tobytes() if n else None for s, n in zip(sig, np.diff(runs), strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array((at[1:] - at[:-1]), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "fp", "bytes", "sig"])

    return run


def _cells(df: DataFrame, group: str, count: str, weight: str | None = None) -> DataFrame:
    """df, a row for each member of a group, with the cells in which the member is compared: a group of more than SIDE members falls
    into parts, and each pair of parts, or a part with itself, is a cell. Adds _cell (long), _part and _single (a part with itself)."""
    parts = F.ceil(F.col(count) / F.lit(SIDE))
    if weight:
        parts = F.greatest(parts, F.ceil(F.col(weight) / F.lit(SIDE_BYTES)))
    df = df.withColumn("_parts", parts.cast("long")).withColumn("_part", F.pmod(F.xxhash64("rid"), F.col("_parts")))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    cell = F.xxhash64(group, F.least("_part", "_other"), F.greatest("_part", "_other"))
    return df.withColumn("_cell", cell).withColumn("_single", F.col("_part") == F.col("_other")).drop("_parts", "_other")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a cell's two sides, each member once; the same rows twice for a part with itself. A cell of two parts of which one
    is empty has no pairs: the other part's are those of its own cell."""
    rid, part = table.column("rid").to_numpy(), table.column("_part").to_numpy()
    first = np.unique(rid, return_index=True)[1]
    if table.column("_single")[0].as_py():
        return first, first
    if part.min() == part.max():
        return first[:0], first[:0]
    return first[part[first] == part[first].min()], first[part[first] == part[first].max()]


def _pairs(a: np.ndarray, b: np.ndarray, sig: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(a), 1) if a is b else (x.ravel() for x in np.indices((len(a), len(b))))
    i, j = pruned(sig[a], sig[b], i, j, least)
    return a[i], b[j]


def _sigs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)


def _tree(i: np.ndarray, j: np.ndarray, rid: np.ndarray) -> pa.RecordBatch | None:
    """Of links between rows, as many as connect what they connect."""
    root = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for a, b in zip(rid[i].tolist(), rid[j].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return pa.record_batch([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"]) if out else None


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-6, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id reachable by links), n_links (other rows linked directly, equal
    texts among them), kept (whether doc_id is class_id).

    Two texts link if the Jaccard similarity of their sets of ``width``-word shingles reaches the threshold. A text of fewer words, but
    one, has all its words as its only shingle; null texts and texts without words link with nothing, and each is its own class. Equal
    texts are one node with a count. A null doc_id comes before all others.

    Candidates: 25 bands of 5 MinHashes, of which a pair at 0.8 meets in one with probability 0.99995; bands with the same members count
    once. Pairs that pass the Bayesian test connect into groups, and each group's texts are compared with each other, again by the test
    and then by whole shingle sets. Large groups are compared in cells of 256 by 256 documents; a cell gives counts and a tree of links,
    never all its pairs. The number of comparisons in a group of near copies does grow with its square; equal texts are compared once.
    """
    least = least_matches(threshold, tolerance)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("fp"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketch = written(rows.mapInArrow(_sketch(width, seed), "doc_id long, fp binary, bytes long, sig binary"), "jaccard-sketch")
    nodes = sketch.where("sig is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("rid", F.monotonically_increasing_id()), "jaccard-nodes")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    met = nodes.select("rid", band.alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("_lo"), F.max("rid").alias("_hi"), F.bit_xor(F.xxhash64("rid")).alias("_x")).where("n > 1")
    shared = shared.groupBy("n", "_lo", "_hi", "_x").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = written(met.join(shared, "bucket"), "jaccard-members")

    cells = _cells(members, "bucket", "n").select("rid", "_cell", "_part", "_single").join(nodes.select("rid", "sig"), "rid")

    def connect(table: pa.Table) -> pa.RecordBatch | None:
        a, b = _sides(table)
        if not len(a) or a is b and len(a) < 2:
            return None
        i, j = _pairs(a, b, _sigs(table), least)
        return _tree(i, j, table.column("rid").to_numpy())

    near = cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(by_group("_cell", connect), "a long, b long")
    groups = components(near)
    sized = groups.join(nodes.select(F.col("rid").alias("node"), "bytes"), "node")
    size = sized.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("_all_bytes"))
    members = groups.join(size, "label").select(F.col("node").alias("rid"), F.col("label").alias("_group"), "n", "_all_bytes").join(nodes.select("rid", "fp", "least_id", "copies", "sig"), "rid")
    members = written(members, "jaccard-groups")
    texts = rows.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_fp"), "text")
    texts = texts.join(members.select("rid", "fp", "least_id", "_group", "n", "_all_bytes", "copies", "sig"), (F.col("_fp") == F.col("fp")) & F.col("_d").eqNullSafe(F.col("least_id")))
    cells = _cells(texts.select("rid", "_group", "n", "_all_bytes", "copies", "sig", "text"), "_group", "n", "_all_bytes").select("rid", "_cell", "_part", "_single", "copies", "sig", "text")

    def verify(table: pa.Table) -> pa.RecordBatch | None:
        a, b = _sides(table)
        if not len(a) or a is b and len(a) < 2:
            return None
        i, j = _pairs(a, b, _sigs(table), least)
        data, at = flat(table.column("text"))
        start, end, first = words(data, at)
        values, runs = shingles(word_hashes(data, start, end), first, width, short=True)
        sets: dict[int, np.ndarray] = {}
        for x in np.unique(np.concatenate([i, j])).tolist():
            sets[x] = np.unique(values[runs[x] : runs[x + 1]])
        good = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            p, q = sets[x], sets[y]
            if min(len(p), len(q)) >= threshold * max(len(p), len(q)) - 1e-9:
                common = len(np.intersect1d(p, q, assume_unique=True))
                good[k] = common >= threshold * (len(p) + len(q) - common) - 1e-9
        i, j = i[good], j[good]
        if not len(i):
            return None
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        links = np.zeros(len(rid), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        tree = _tree(i, j, rid)
        some = np.flatnonzero(links)
        n, m = len(some), tree.num_rows
        return pa.record_batch([pa.array(np.concatenate([rid[some], tree.column(0).to_numpy()])), pa.array([None] * n + tree.column(1).to_pylist(), pa.int64()), pa.array(np.concatenate([links[some], np.zeros(m, np.int64)]))], names=["a", "b", "links"])

    found = written(cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(by_group("_cell", verify), "a long, b long, links long"), "jaccard-links")
    links = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("_links"))
    labels = components(found.where("b is not null")).select(F.col("node").alias("rid"), "label")
    known = nodes.select("rid", "fp", "copies", "least_id").join(links, "rid", "left").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    low = known.groupBy("label").agg(F.min(F.struct(F.col("least_id").isNotNull(), F.col("least_id"))).alias("_low"))
    known = written(known.join(low, "label").select("fp", "copies", F.coalesce("_links", F.lit(0).cast("long")).alias("_links"), F.col("_low.least_id").alias("class_id")), "jaccard-known")
    out = sketch.select("doc_id", "fp", F.col("sig").isNotNull().alias("_some"))
    out = out.join(known, ["fp"], "left")
    return out.select(
        "doc_id", F.when(F.col("_some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("_some"), F.col("copies") - 1 + F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_some"), F.col("doc_id").eqNullSafe(F.col("class_id"))).otherwise(F.lit(True)).alias("kept"))


def op7(docs: DataFrame) -> DataFrame:
    """Classes of all documents by the Jaccard similarity of five-word shingles, 0.8 or more."""
    return jaccard_classes(docs)


def without_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs with the first document of each class; rows that repeat its doc_id are that document too, and stay with it."""
    def work(docs: DataFrame) -> DataFrame:
        classes = jaccard_classes(docs, **how).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(classes, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")

    return shielded(docs, work)
