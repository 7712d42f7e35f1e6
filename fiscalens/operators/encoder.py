"""Texts as vectors: latent semantic vectors from a randomised singular value decomposition of tf-idf weights, fitted on all rows by Spark.

A text's words are hashed to ``features`` columns, so that what a task, the driver or a broadcast holds (features * (dims + extra)
numbers) does not depend on the corpus. The decomposition (after Halko et al., 2011) multiplies a random block by the matrix and its transpose
a few times; each task adds up its own rows' share, and the shares are added some at a time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import written

WORD = re.compile(r"[^\W_]+")
#: Shares that are added at once, and rows of the block that travel together.
FAN_IN, ROWS = 32, 1024
#: Words of more than one text up to which each executor has all of them with their counts (20 bytes each); more are joined by a shuffle.
#: And words that are weighed at once.
SENT, WORDS = 1 << 22, 1 << 20


class Lsa(NamedTuple):
    """idf of each feature, and for each feature its row of the axes, divided by their singular values."""

    idf: np.ndarray
    axes: np.ndarray


def counted(text: str | None, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of a text's words, how often each occurs), by feature."""
    found = [zlib.crc32(w.encode()) % features for w in WORD.findall(text.lower())] if text else []
    return np.unique(np.array(found, np.int32), return_counts=True)


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Of a text's features, with a length of 1."""
    w = (1 + np.log(tf)) * idf
    return w / math.sqrt(float(w @ w)) if len(w) else w


def _counts(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counted(t, features) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([f.tobytes() for f, _ in rows], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in rows], pa.binary())], names=["f", "n"])

    return run


def _document_counts(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(features, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for f in batch.column(0).to_pylist():
                df[np.frombuffer(f, np.int32)] += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], names=["f", "n"])

    return run


def _products(block: np.ndarray, idf: np.ndarray, small: bool):
    """A task's share of A'(A block), in stripes of rows, or of (A block)'(A block) if ``small``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = block.shape[1]
        out = np.zeros((width if small else len(block), width))
        for batch in batches:
            for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(f, np.int32)
                if len(at):
                    w = weights(np.frombuffer(n, np.int32), idf[at])
                    y = w @ block[at]
                    if small:
                        out += np.outer(y, y)
                    else:
                        out[at] += np.outer(w, y)
        stripes = range(0, len(out), ROWS)
        yield pa.record_batch([pa.array([k // ROWS for k in stripes], pa.int32()), pa.array([out[k : k + ROWS].tobytes() for k in stripes], pa.binary())], names=["stripe", "sums"])

    return run


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for x in pdf["sums"]:
        total = total + np.frombuffer(x)
    return pd.DataFrame({"stripe": [key[0]], "task": [key[1]], "sums": [total.tobytes()]})


def _summed(rows: DataFrame, block: np.ndarray, idf: np.ndarray, small: bool = False) -> np.ndarray:
    shares = rows.mapInArrow(_products(block, idf, small), "stripe int, sums binary").withColumn("task", F.spark_partition_id())
    for level in range(max(1, math.ceil(math.log(max(2, rows.rdd.getNumPartitions()), FAN_IN)))):
        shares = shares.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("stripe", "task").applyInPandas(_added, "stripe int, task int, sums binary")
    found = sorted((r.stripe, bytes(r.sums)) for r in shares.collect())  # the block's rows, once each
    return np.concatenate([np.frombuffer(x).reshape(-1, block.shape[1]) for _, x in found])


def fit(docs: DataFrame, text: str = "text", dims: int = 128, features: int = 1 << 15, extra: int = 16, passes: int = 2, seed: int = 1) -> Lsa:
    """The ``dims`` leading axes of the tf-idf matrix of all texts, whitened: along each of them the corpus varies alike, so that what all
    texts of a language share does not make them near. Null and empty texts are rows of zeros; a corpus of less rank has axes of zeros."""
    rows = written(docs.select(text).mapInArrow(_counts(features), "f binary, n binary"), "text-features")
    df = {r.f: r.n for r in rows.select("f").mapInArrow(_document_counts(features), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}  # a row a feature
    count, known = df.pop(-1, 0), np.zeros(features)
    for f, n in df.items():
        known[f] = n
    idf = np.log((1 + count) / (1 + known)) + 1
    block = np.random.Generator(np.random.Philox(seed)).standard_normal((features, dims + extra))
    for _ in range(passes):
        block = np.linalg.qr(_summed(rows, block, idf))[0]
    value, turn = np.linalg.eigh(_summed(rows, block, idf, small=True))
    value, turn = value[::-1][:dims], turn[:, ::-1][:, :dims]
    scale = np.where(value > 1e-9 * max(float(value[0]), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0)
    return Lsa(idf, ((block @ turn) * scale).astype(np.float32))


def encode_with(spark: SparkSession, model: Lsa) -> Callable[[Column], Column]:
    """An encoder of text columns: arrays of doubles, of zeros for a text without known words. The model is sent to each executor once."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        idf, axes = sent.value
        for texts in batches:
            rows = [counted(t, len(idf)) for t in texts]
            yield pd.Series([(weights(n, idf[f]) @ axes[f]).astype(float) if len(f) else np.zeros(axes.shape[1]) for f, n in rows])

    return vector


class Table(NamedTuple):
    """Words by ascending hash: f, df, and their place by falling df; and df by this place."""

    f: np.ndarray
    df: np.ndarray
    place: np.ndarray
    placed: np.ndarray


class Words(NamedTuple):
    """Of a corpus its rows, the words that more than one row has (f: a word's hash, df: rows that have it), and the same as a Table that
    executors have, unless they are more than SENT."""

    rows: int
    known: DataFrame
    sent: Broadcast | None


def hashed(text: str) -> Column:
    """The hashes of a text's words: runs of letters and digits in lower case."""
    return F.transform(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def document_frequencies(docs: DataFrame, text: str) -> Words:
    """Counted in each task before they are exchanged, so that what moves is words, not the words of each text."""
    df = docs.select(F.explode(F.array_distinct(hashed(text))).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    known = written(df.where("df > 1"), "word-rows")
    sent = None
    if known.count() <= SENT:
        table = known.toPandas().sort_values("f")
        f, often = table["f"].to_numpy(np.int64), table["df"].to_numpy(np.int64).clip(max=(1 << 31) - 1).astype(np.int32)
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(f), np.int32)
        place[order] = np.arange(len(f))
        sent = docs.sparkSession.sparkContext.broadcast(Table(f, often, place, often[order]))
    return Words(docs.count(), known, sent)


def _counted_words(batch: pa.RecordBatch, carried: int, known: Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time, by row (from 0) the different words: their hashes, how often the row has each, and its index in the table or -1."""
    whole = batch.column(carried)
    upto = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(whole), 0).to_numpy())])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + WORDS, "right")) - 1)
        part = batch.slice(lo, hi - lo)
        f, doc = part.column(carried).flatten().to_numpy(), np.repeat(np.arange(hi - lo), np.diff(upto[lo : hi + 1]))
        lo = hi
        if len(f):
            order = np.lexsort((f, doc))
            f, doc = f[order], doc[order]
            heads = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])]))
            tf, f, doc = np.diff(np.append(heads, len(f))), f[heads], doc[heads]
            at = np.minimum(np.searchsorted(known.f, f), max(0, len(known.f) - 1))
            yield part, doc, f, tf, np.where(known.f[at] == f, at, -1) if len(known.f) else np.full(len(f), -1)


def _tfidf(tf: np.ndarray, df: np.ndarray, rows: int) -> np.ndarray:
    return (1 + np.log(tf)) * (1 + np.log((1.0 + rows) / (1 + df)))


def _weighted(carried: int, rows: int, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part, doc, f, tf, at in _counted_words(batch, carried, known):
                df = np.where(at < 0, 1, known.df[at] if len(known.df) else 1).astype(np.int64)
                w = _tfidf(tf, df, rows)
                w /= np.sqrt(np.bincount(doc, w * w))[doc]
                order = np.lexsort((f, df, doc))
                some, first = np.unique(doc, return_index=True)
                terms = pa.StructArray.from_arrays([pa.array(df[order]), pa.array(f[order]), pa.array(w[order])], names=["df", "f", "w"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), terms)
                yield pa.record_batch([*[part.column(k).take(pa.array(some)) for k in range(carried)], lists], names=[*batch.schema.names[:carried], "terms"])

    return run


def _coded(x: np.ndarray) -> bytes:
    """Numbers from 0, small ones as a byte each."""
    large = x[x >= 255].astype("<u4")
    return np.array([len(x), len(large)], "<u4").tobytes() + np.minimum(x, 255).astype("u1").tobytes() + large.tobytes()


def _decoded(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, large = np.frombuffer(raw, "<u4", 2, at).tolist()
    x = np.frombuffer(raw, "u1", n, at + 8).astype(np.int64)
    x[x == 255] = np.frombuffer(raw, "<u4", large, at + 8 + n)
    return x, at + 8 + n + 4 * large


def _packed(rows: int, sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part, doc, _, tf, at in _counted_words(batch, 1, known):
                w = _tfidf(tf, np.where(at < 0, 1, known.df[at] if len(known.df) else 1), rows)
                norm = np.sqrt(np.bincount(doc, w * w, minlength=part.num_rows))
                shared = at >= 0
                doc, tf, place = doc[shared], tf[shared], known.place[at[shared]]
                order = np.lexsort((place, doc))
                tf, place, upto = tf[order], place[order], np.searchsorted(doc, np.arange(part.num_rows + 1))
                some = np.flatnonzero(norm)
                raw = [norm[i].tobytes() + zlib.compress(_coded(np.diff(place[a:b], prepend=0)) + _coded(tf[a:b])) for i, a, b in zip(some, upto[some], upto[some + 1], strict=True)]
                yield pa.record_batch([part.column(0).take(pa.array(some)), pa.array(raw, pa.binary())], names=[batch.schema.names[0], "packed"])

    return run


def packed(docs: DataFrame, doc_id: str, text: str, words: Words) -> DataFrame:
    """The vectors of weighted() in few bytes (doc_id, packed), where the words are sent: of the words that other texts have too their places
    and numbers, and the norm of all. unpacked() gives the places and weights of one."""
    return docs.select(doc_id, hashed(text).alias("_f")).mapInArrow(_packed(words.rows, words.sent), f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, packed binary")


def unpacked(words: Words) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
    rows, sent = words.rows, words.sent

    def of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        body = zlib.decompress(raw[8:])
        steps, at = _decoded(body, 0)
        place, tf = np.cumsum(steps), _decoded(body, at)[0]
        return place, _tfidf(tf, sent.value.placed[place], rows) / np.frombuffer(raw, np.float64, 1)[0]

    return of


def weighted(docs: DataFrame, doc_id: str, text: str, words: Words) -> DataFrame:
    """docs with terms in place of the text, as of tfidf(), by what was counted over the corpus that they are of. Where the words are sent,
    this is made from each text by itself, without a shuffle."""
    own = [c for c in docs.columns if c != text]
    if words.sent is not None:
        kinds = dict(docs.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "terms array<struct<df: long, f: long, w: double>>"])
        return docs.select(*own, hashed(text).alias("_f")).mapInArrow(_weighted(len(own), words.rows, words.sent), schema)
    tf = docs.select(doc_id, F.explode(hashed(text)).alias("f")).groupBy(doc_id, "f").agg(F.count(F.lit(1)).alias("tf"))
    w = (1 + F.log("tf")) * (1 + F.log(F.lit(1.0 + words.rows) / (1 + F.col("df"))))
    rows = tf.join(words.known, "f", "left").na.fill(1, ["df"]).select(doc_id, "df", "f", w.alias("w"))
    rows = rows.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("df", "f", "w"))).alias("terms"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    rows = rows.select(doc_id, F.transform("terms", lambda x: F.struct(x["df"].alias("df"), x["f"].alias("f"), (x["w"] / F.col("_norm")).alias("w"))).alias("terms"))
    return docs.select(*own).join(rows, doc_id).select(*own, "terms")


def tfidf(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts as sparse vectors of length 1: doc_id, terms (array of df, f: the word's hash, w), rarest words first.

    Words are runs of letters and digits in lower case; (1 + ln tf) * (1 + ln((1 + N) / (1 + df))). A text without words has no row;
    ids are each row's own.
    """
    rows = docs.select(doc_id, text)
    return weighted(rows, doc_id, text, document_frequencies(rows, text))
