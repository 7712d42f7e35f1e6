"""Periodic runs of words by heavy and light lag counting.

A run of period q and length L holds L - q pairs of equal words q apart, one behind the other. How many equal pairs a text has at each
lag is counted exactly: frequent words by an autocorrelation of where they stand (a Fourier transform of each, one back for their sum),
rare ones by the differences of their places. Only a lag with as many pairs as its shortest run needs is scanned for islands of
consecutive pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import pieces

#: Pairs of rare words that are held at once.
PAIRS = 1 << 20
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def lag_matches(ids: np.ndarray, longest: int) -> np.ndarray:
    """For each lag from 0 to ``longest``: how many words equal the word so far behind them (0 at lag 0). ids: small numbers of the words."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    count = np.bincount(ids)
    size = 1 << (n + longest).bit_length()
    # a transform costs about as much as so many pairs
    heavy = count * (count - 1.0) / 2 > 2000 + 0.1 * size * np.log2(size)
    begin = np.cumsum(count) - count
    matches = np.zeros(longest + 1, np.int64)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy).tolist():
            stands = np.zeros(size)
            stands[order[begin[word] : begin[word] + count[word]]] = 1
            f = np.fft.rfft(stands)
            power += f.real**2 + f.imag**2
        matches += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
    earlier = np.arange(n) - np.repeat(begin, count)  # of each place in order: equal words before it
    earlier[np.repeat(heavy, count)] = 0
    upto = np.cumsum(earlier)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        some = earlier[lo:hi]
        total = int(some.sum())
        if total:
            first = np.repeat(np.arange(lo, hi) - some - (np.cumsum(some) - some), some)
            lag = np.repeat(order[lo:hi], some) - order[first + np.arange(total)]
            matches += np.bincount(lag[lag <= longest], minlength=longest + 1)
        lo = hi
    matches[0] = 0
    return matches


def _equal_after(ids: np.ndarray, at: int, lag: int) -> int:
    """How many consecutive pairs (i, i + lag) from i = at on are equal."""
    end, total, step = len(ids) - lag, 0, 16
    while at < end:
        upto = min(end, at + step)
        differ = ids[at:upto] != ids[at + lag : upto + lag]
        k = int(differ.argmax())
        if differ[k]:
            return total + k
        total, at, step = total + upto - at, upto, step * 4
    return total


def _equal_before(ids: np.ndarray, at: int, lag: int, least: int) -> int:
    """How many consecutive pairs from i = at - 1 back to ``least`` are equal."""
    total, step = 0, 16
    while at > least:
        low = max(least, at - step)
        differ = (ids[low:at] != ids[low + lag : at + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return total + k
        total, at, step = total + at - low, low, step * 4
    return total


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, pairs) of all stretches of ``least`` or more consecutive equal pairs at a lag. Each holds a pair whose number is a multiple
    of ``least``, so only those are looked at, and stretches grow from them."""
    at = np.arange(0, len(ids) - lag, least)
    out, done = [], 0
    for i in at[ids[at] == ids[at + lag]].tolist():
        if i < done:
            continue
        start = i - _equal_before(ids, i, lag, done)
        done = i + _equal_after(ids, i, lag)
        if done - start >= least:
            out.append((start, done - start))
    return out


def runs(ids: np.ndarray, shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of max(shortest, 2 * period) words or more, by start, then period.

    Lags are scanned in rising order, so that a stretch is first met at its smallest period. A run of period p also matches at p's
    multiples; those pairs are taken off their counts, which leaves what other runs need: a run whose smallest period is a multiple q of
    p shares fewer than q words with it, and so none of its pairs.
    """
    n = len(ids)
    if n < shortest:
        return []
    longest = n // 2
    lags = np.arange(longest + 1)
    least = np.maximum(np.maximum(shortest - lags, lags), 1)
    matches = lag_matches(ids, longest)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(matches >= least).tolist():
        if matches[q] < least[q]:
            continue
        for start, pairs in islands(ids, q, int(least[q])):
            if (start, pairs + q) not in found:
                found[start, pairs + q] = q
                more = np.arange(2 * q, min(pairs + q, longest + 1), q)
                matches[more] -= pairs + q - more
    return sorted((start, length, q) for (start, length), q in found.items())


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _scan(shortest: int, rewrite: Rewrite | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                doc_ids = batch.column(0).slice(lo, hi - lo)
                counts, found, ends, texts = [], [], [0], []
                for doc_id, text in zip(doc_ids.to_pylist(), batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist(), strict=True):
                    words = (text or b"").split()  # at \x20 and \x09 to \x0D
                    if rewrite:
                        words = rewrite(doc_id, words)
                    number: dict[bytes, int] = {}
                    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                    own = runs(ids, shortest)
                    counts.append(len(words))
                    found += own
                    ends.append(len(found))
                    if own:
                        cover = np.zeros(len(words) + 1, np.int64)
                        start, length, period = np.array(own).T
                        np.add.at(cover, start + period, 1)
                        np.add.at(cover, start + length, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    texts.append(b" ".join(words))
                columns = np.array(found, np.int64).reshape(-1, 3).T
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"]))
                yield pa.record_batch([doc_ids, pa.array(counts, pa.int64()), spans, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = 12, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_words, runs (all maximal periodic runs of its words, by start, then period), collapsed (its words
    joined by a space, without those that a run contains after its first period).

    A run is ``shortest`` words long at least, and twice its smallest period. Null, empty and short texts have no runs; a text is taken
    whole, in one task, in memory of about its words. Rows are looked at alone, so repeated rows and ids give the same again; other
    columns are not read. rewrite: gets a row's id and words and gives the words to look at.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(shortest, rewrite), RUNS)


def with_cycles(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, every tenth document (by crc32 of its id) with a tail that repeats; a document without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11(docs: DataFrame) -> DataFrame:
    """All documents, some with planted cycles: number of runs, the longest one, digests of the runs and of the collapsed text.

    Of equally long runs the first is taken, then the one of the smaller period; four nulls without a run, and digests of nothing. An empty
    table gives no rows.
    """
    found = periodic_runs(docs, rewrite=with_cycles)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
