"""Quality rules: base rules on words and lines, then tokeniser fertility with rejection bands per language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textkernel import SPACE, flat, pieces, shingles, word_hashes, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"
_models: dict[str, tuple] = {}


def vocabulary(path: str):
    """The SentencePiece model at path, and which of its ids are bytes; loaded once a worker."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _models[path] = model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return _models[path]


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text: its words that lie in a window of ``width`` words found twice or more in the text."""
    values, runs = shingles(hashes, first, width, short=False)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(runs))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = np.zeros(len(v), bool)
    if len(v) > 1:
        equal = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        same[1:] |= equal
        same[:-1] |= equal
    begin = (np.repeat(first[:-1] - runs[:-1], np.diff(runs)) + np.arange(len(values)))[order[same]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(_BLANK))


def _entropy(ids: np.ndarray) -> float:
    """Bits a token, over the most that so many tokens of this vocabulary could have; 1 for a single token."""
    if len(ids) < 2:
        return 1.0
    n = np.bincount(ids)
    n = n[n > 0]
    return float((np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids)) / np.log2(len(ids)))


MEASURES = ["chars_per_token", "byte_share", "token_entropy"]
STATS = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, is_byte = vocabulary(path)
        for batch in batches:
            for lo, hi in pieces(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                data, at = flat(part.column(2))
                start, end, first = words(data, at)
                total = lambda mask, at=at: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])
                lead = (data & 0xC0) != 0x80
                texts = part.column(2).fill_null("").to_pylist()
                tokens, chars, byte, entropy = [], total(lead), [], []
                for text in texts:
                    ids = np.array(model.encode(text, num_threads=1), np.int32)
                    tokens.append(len(ids))
                    byte.append(float(is_byte[ids].mean()) if len(ids) else None)
                    entropy.append(_entropy(ids) if len(ids) else None)
                per = [c / t if t else None for c, t in zip(chars.tolist(), tokens, strict=True)]
                columns = [part.column(0), part.column(1), np.diff(first), total(lead & ~SPACE[data]), total(SYMBOLS[data]), [repeated_lines(t) for t in texts], repeated_words(word_hashes(data, start, end), first), tokens, per, byte, entropy]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns[:8]] + [pa.array(c, pa.float64()) for c in columns[8:]], names=[x.split()[0] for x in STATS.split(", ")])

    return run


def measures(docs: DataFrame, path: str, band: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs the base counts and the fertility of its text under the vocabulary at path. Null texts are empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(band).cast("string").alias("band"), F.col(text).alias("text")).mapInArrow(_measure(path), STATS)


def bands(stats: DataFrame, reach: float, digits: int = 4) -> DataFrame:
    """For each band key (a language or script; null is one too) and measure the lowest and highest value let pass: ``reach`` times the
    interquartile range beyond the quartiles of all texts of 20 words or more.

    Values are counted at ``digits`` decimals, so that quartiles are exact there and the same in every run, and a window holds as many
    rows as there are different values, not texts.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, digits).alias("value")) for c in MEASURES]))
    counted = stats.where("n_words >= 20").select("band", each.alias("_m")).groupBy("band", "_m.measure", "_m.value").agg(F.count(F.lit(1)).alias("texts"))
    counted = counted.where("value is not null")
    own = Window.partitionBy("band", "measure")
    upto = F.sum("texts").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).withColumn("_all", F.sum("texts").over(own))
    quartile = lambda c, part: F.min(F.when((F.col("measure") == c) & (F.col("_upto") >= part * F.col("_all")), F.col("value")))
    out = placed.groupBy("band").agg(*[quartile(c, part).alias(f"{c}_{part}") for c in MEASURES for part in (0.25, 0.75)])
    low, high = (lambda c: F.col(f"`{c}_0.25`")), (lambda c: F.col(f"`{c}_0.75`"))
    edges = [e for c in MEASURES for e in ((low(c) - reach * (high(c) - low(c))).alias(f"{c}_low"), (high(c) + reach * (high(c) - low(c))).alias(f"{c}_high"))]
    return out.select(F.col("band").alias("_band"), *edges)


def quality(docs: DataFrame, path: str | None = None, band: str = "lang", reach: float = 6.0, slack: dict[str, float] | None = None, most_bands: int = 10_000) -> DataFrame:
    """Base counts, fertility, base_failed and kept for each row of docs.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. kept: not base_failed, and each of
    characters per token, share of byte-fallback tokens and token entropy lies in its language's band, widened by ``slack``, a least
    distance beyond the quartiles, so that uniform corpora do not reject what barely differs. A language with no text of 20 words has no band.
    The bands are broadcast if they are ``most_bands`` rows at most, and joined by a shuffle beyond.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    slack = {"chars_per_token": 0.5, "byte_share": 0.05, "token_entropy": 0.1} | (slack or {})
    stats = written(measures(docs, path, band), "fertility")
    limits = written(bands(stats, reach), "fertility-bands")
    few = limits.count() <= most_bands
    joined = stats.join(F.broadcast(limits) if few else limits, F.col("band").eqNullSafe(F.col("_band")), "left")
    inside = F.lit(True)
    for c in MEASURES:
        inside &= F.coalesce(F.col(c).between(F.col(f"{c}_low") - slack[c], F.col(f"{c}_high") + slack[c]), F.lit(True))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def op9(docs: DataFrame) -> DataFrame:
    """The base counts and the verdict for all documents, with the measures behind it, a row for each row of docs.

    Null and empty texts have zeros, null measures and fail the base rules; texts are taken whole. Repeated rows are measured alike and
    count each in the bands. Other columns are not read; an empty table gives no rows.
    """
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES)
