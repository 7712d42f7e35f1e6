"""Pairs of vectors with a cosine above a threshold, exactly: sparse vectors by a prefix-filtered inverted index with norm bounds, dense ones
in cells by matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import written

#: Rows of a posting list or a group that meet in one cell, terms before one that its entry in the index has, and what rounding may take
#: off a bound.
CELL, BEHIND, SLACK = 512, 2, 1e-9


def in_cells(df: DataFrame, keys: list[str], by: str, cell: int) -> DataFrame:
    """df with _u, _v and _part: rows of equal keys fall into parts of about ``cell`` rows, and each row goes to the cells (_u <= _v) of its part
    with every part, so that any two rows of a key meet in exactly one cell (that of their part, or of their two parts). Keys of one
    row are left out."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / cell).cast("long").alias("_parts"))
    dealt = df.join(size, keys).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return dealt.withColumns({"_u": F.least("_part", "_other"), "_v": F.greatest("_part", "_other")}).drop("_other", "_parts")


def _prefixes(threshold: float, carried: int):
    """Of each vector the terms of its prefix that others have too, with the norm of what stands from each of them on, and the BEHIND terms
    before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(carried)
            flat, at = terms.flatten(), np.concatenate([[0], np.cumsum(np.fromiter((len(x) if x.is_valid else 0 for x in terms), np.int64, len(terms)))])
            f, w, df = flat.field("f").to_numpy(), flat.field("w").to_numpy(), flat.field("df").to_numpy()
            row, term, rest, before = [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                # norms of the vector from each term on; a vector whose rest is below the threshold cannot reach it there any more
                norm = np.sqrt(np.cumsum((w[a:b] * w[a:b])[::-1])[::-1])
                n = int(np.searchsorted(-norm, -(threshold - SLACK), "right"))
                alone = int(np.searchsorted(df[a : a + n], 1, "right"))  # these come first
                row += [i] * (n - alone)
                term += f[a + alone : a + n].tolist()
                rest += norm[alone:n].tolist()
                before += [f[a + max(alone, k - BEHIND) : a + k] for k in range(alone, n)]
            taken = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(carried)]
            yield pa.record_batch([*taken, pa.array(term, pa.int64()), pa.array(rest, pa.float64()), pa.array(before, pa.list_(pa.int64()))], names=[*batch.schema.names[:carried], "_term", "_rest", "_before"])

    return run


def candidates(vectors: DataFrame, threshold: float, on: list[str], condition: Column | None = None, key: str = "id") -> DataFrame:
    """Pairs (a, b: ids, a's smaller unless ``condition`` says which is which) that may reach the threshold, each once.

    Two vectors that do share a term in their prefixes (the terms, rarest first, up to where the norm of the rest is below the threshold):
    else their common terms all lie in the rest of one of them. A pair is taken at its first common term, if the norms of both vectors
    from there on allow the threshold; where it has another one just before, it is not looked at again, and what else recurs is made
    distinct, so that an entry of the index has a bounded size. Terms are ordered by their frequency, so prefixes hold a text's rarest
    words (one of a single vector is not listed), and a list that is long nevertheless is met in cells.
    """
    own = [c for c in vectors.columns if c not in ("terms", key)]
    rows = vectors.select(key, *own, "terms")
    order = ", ".join(f"`{c}` {dict(vectors.dtypes)[c]}" for c in [key, *own])
    entries = written(rows.mapInArrow(_prefixes(threshold, 1 + len(own)), f"{order}, _term long, _rest double, _before array<long>"), "prefix-index")
    dealt = in_cells(entries, [*on, "_term"], key, CELL)
    left = dealt.select(*on, "_term", "_u", "_v", F.col("_part").alias("_ap"), F.col("_rest").alias("_ar"), F.col("_before").alias("_ab"), *[F.col(c).alias(f"a_{c}") for c in [key, *[c for c in own if c not in on]]])
    met = left.join(dealt, [*on, "_term", "_u", "_v"]).where("_u = _v or _ap <> _part").where(F.col("_ar") * F.col("_rest") >= threshold - SLACK)
    met = met.where(~F.arrays_overlap("_ab", "_before"))
    return met.where(F.col(f"a_{key}") < F.col(key) if condition is None else condition).select(F.col(f"a_{key}").alias("a"), F.col(key).alias("b")).distinct()


def _dots(unpack: Callable[[bytes], tuple[np.ndarray, np.ndarray]] | None):
    """The products of two vectors a row, each as an array of terms and one of weights, or packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(column: pa.Array) -> list[np.ndarray]:
            at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
            return np.split(column.flatten().to_numpy(), at[1:-1])

        def vectors(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if unpack is None:
                yield from zip(*map(split, columns), strict=True)
                return
            last, vector = None, None
            for x in columns[0]:  # the same one often comes several times in a row
                raw = x.as_py()
                if raw != last:
                    last, vector = raw, unpack(raw)
                yield vector

        for batch in batches:
            found, half = [], batch.num_columns // 2
            for (f, w), (g, v) in zip(vectors(batch.columns[2 : half + 1]), vectors(batch.columns[half + 1 :]), strict=True):
                _, i, j = np.intersect1d(f, g, assume_unique=True, return_indices=True)
                found.append(min(1.0, float(w[i] @ v[j])))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def sparse_pairs(vectors: DataFrame, threshold: float, on: list[str], condition: Column | None = None, key: str = "id") -> DataFrame:
    """All pairs (a, b, similarity) of vectors (key, columns of ``on``, terms as of encoder.tfidf) of equal ``on`` with a cosine above the threshold.

    condition: on the columns of both, those of a with a_ before their names; without it a is the smaller id.
    """
    pairs = written(candidates(vectors, threshold, on, condition, key), "candidates")
    return scored(pairs, vectors.join(members(pairs, key), key, "left_semi"), threshold, key)


def members(pairs: DataFrame, key: str = "id") -> DataFrame:
    """The ids that pairs (a, b) name, each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()


def scored(pairs: DataFrame, vectors: DataFrame, threshold: float, key: str = "id", unpack: Callable[[bytes], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """pairs (a, b) with the similarity of their vectors (key and terms, or packed with what unpacks one), where it is above the threshold."""
    kind = dict(vectors.dtypes)[key]
    columns = {"f": F.col("terms.f"), "w": F.col("terms.w")} if unpack is None else {"packed": F.col("packed")}
    of = written(vectors.select(key, *[x.alias(name) for name, x in columns.items()]), "candidate-vectors")
    side = lambda name: of.select(F.col(key).alias(name), *[F.col(x).alias(f"{name}_{x}") for x in columns])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *[f"{name}_{x}" for name in ("a", "b") for x in columns]).mapInArrow(_dots(unpack), f"a {kind}, b {kind}, similarity double").where(F.col("similarity") > threshold)


def dense_pairs(new: DataFrame, old: DataFrame, keys: list[str], kind: str, allowed: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray], threshold: float, cell: int = 2048) -> DataFrame:
    """Pairs (a of new, b of old, similarity) of equal keys with a cosine above the threshold. Both have id (of type ``kind``), keys and
    vector; ``allowed`` gets the rows of both sides and the numbers of the pairs found, and says which may be.

    Groups fall into cells of ``cell`` by ``cell`` rows at most about, of which each is one product of two matrices; only what is found
    leaves it. A vector of zeros is like none. Products and norms of counts are exact, and rounded once at the root of the norms and once in
    the quotient, so that a cosine of counts that is the threshold is not above it.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / cell).cast("long").alias(name))

    sizes = parts(new, "_i").join(parts(old, "_j"), keys)

    def side(df: DataFrame, own: str, other: str, is_new: bool) -> DataFrame:
        dealt = df.join(sizes, keys).withColumn("_p", F.pmod(F.xxhash64("id"), F.col(own)))
        dealt = dealt.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn("_new", F.lit(is_new))
        where = F.struct("_p", "_q") if is_new else F.struct(F.col("_q").alias("_p"), F.col("_p").alias("_q"))
        return dealt.withColumn("_at", where).drop("_p", "_q", "_i", "_j")

    rows = side(new, "_i", "_j", True).unionByName(side(old, "_j", "_i", False))

    def work(table: pa.Table) -> pa.Table:
        is_new = table.column("_new").combine_chunks()
        n, o = table.filter(is_new), table.filter(pa.compute.invert(is_new))
        none = pa.table({"a": pa.array([], n.schema.field("id").type), "b": pa.array([], n.schema.field("id").type), "similarity": pa.array([], pa.float64())})
        if not n.num_rows or not o.num_rows:
            return none

        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """Vectors, scaled by powers of two (exactly) so that no square leaves a double, and the squares of their norms."""
            x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])
            return x, (x * x).sum(1)

        (x, p), (y, q) = matrix(n), matrix(o)
        size = np.sqrt(np.outer(p, q))
        s = np.divide(x @ y.T, size, out=np.zeros_like(size), where=size > 0)
        i, j = np.nonzero(s > threshold)
        good = allowed(n, o, i, j)
        i, j = i[good], j[good]
        return pa.table({"a": n.column("id").take(pa.array(i)), "b": o.column("id").take(pa.array(j)), "similarity": pa.array(np.clip(s[i, j], -1, 1))})

    return rows.groupBy(*keys, "_at").applyInArrow(work, f"a {kind}, b {kind}, similarity double")
