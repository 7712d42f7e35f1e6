"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, pseudorandom index permutations."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import WORD, numbered, running_total, shielded, written


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most_times: float = 2.0) -> DataFrame:
    """sizes (source, source_size: one row a source) with target.

    Weights repeat over the sources by code point, null last. The targets share ``share`` times the total by weight; a target stops at
    ``most_times`` its source's size, and the excess goes to the others by weight until none is above. Each round is one aggregate over
    the sources, of which there may be many: those whose size over weight lies below the level stop, and the level rises for the rest.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_n", "mix-sources")
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_n", F.lit(len(weights))) + 1).cast("int")))
    ranked = written(ranked.withColumn("_at", most_times * F.col("source_size") / F.col("_w")).drop("_n"), "mix-weights")
    level, before = -1.0, None
    while True:
        full = F.col("_at") <= F.lit(level)
        row = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("open")).first()
        if not row["open"] or row == before:
            break
        level, before = (share * row["all"] - most_times * row["full"]) / row["open"], row
    stopped = F.lit(not row["open"]) | (F.col("_at") <= F.lit(level))
    return ranked.select("source", "source_size", F.when(stopped, most_times * F.col("source_size")).otherwise(F.col("_w") * F.lit(level)).cast("double").alias("target"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1, at index: four Feistel rounds on the next power of four, repeated until the value is in range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.astype(np.uint64), np.ones(len(index), bool)
    while left.any():
        a, b, m, h, k = out[left] >> half[left], out[left] & mask[left], mask[left], half[left], key[left]
        for turn in range(4):
            x = (b + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            a, b = b, a ^ (x & m)
        out[left] = (a << h) | b
        left[left] = out[left] >= size[left].astype(np.uint64)
    return out.astype(np.int64)


def source_key(source: str | None, seed: int) -> int:
    name = b"\x00" if source is None else b"\x01" + source.encode()
    return zlib.crc32(name, seed & 0xFFFFFFFF) << 32 | zlib.crc32(b"mix" + name, seed >> 32)


def shard_counts(sources: DataFrame, shards: int, seed: int, groups: int = 256) -> DataFrame:
    """sources (source, slots) as one row for each source and output shard that takes slots of it: source, shard, first, slots.

    Every shard has its part of all slots and draws them from the sources: a multinomial by the sources' slots, as their targets ask.
    The draw falls into two, first between ``groups`` of sources, whose sums alone reach the driver, and then within each group, so
    that many sources are drawn by many tasks. Then each source's counts are corrected to its slots: what it has too many is taken
    from its shards at random, what it lacks is dealt to random shards.
    """
    grouped = sources.where("slots > 0").select("source", F.col("slots").cast("long").alias("slots"), F.pmod(F.xxhash64("source"), F.lit(groups)).alias("_group"))
    sums = {r["_group"]: r["slots"] for r in grouped.groupBy("_group").agg(F.sum("slots").alias("slots")).collect()}
    order, total = sorted(sums), sum(sums.values())
    share = np.array([sums[g] for g in order], float) / max(1, total)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
        group, slots = int(pdf["_group"].iloc[0]), pdf["slots"].to_numpy()
        own, found = order.index(group), []
        for shard in range(shards):
            size = total * (shard + 1) // shards - total * shard // shards
            n = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, share)[own]
            counts = np.random.Generator(np.random.Philox(key=[seed, shard + (group + 1 << 32)])).multinomial(n, slots / slots.sum())
            some = np.flatnonzero(counts)
            found.append((some, np.full(len(some), shard), counts[some]))
        row, shard, count = (np.concatenate([f[i] for f in found]) for i in range(3))
        by = np.argsort(row, kind="stable")
        row, shard, count = row[by], shard[by], count[by]
        ends = np.searchsorted(row, np.arange(len(pdf) + 1))
        out = []
        for i, source in enumerate(pdf["source"]):
            source = None if pd.isna(source) else source
            full = np.zeros(shards, np.int64)
            full[shard[ends[i] : ends[i + 1]]] = count[ends[i] : ends[i + 1]]
            more, rng = int(full.sum() - slots[i]), np.random.Generator(np.random.Philox(source_key(source, seed)))
            if more > 0:
                full -= rng.multivariate_hypergeometric(full, more, method="marginals")
            elif more < 0:
                full += rng.multinomial(-more, np.full(shards, 1 / shards))
            on, first = np.flatnonzero(full), np.cumsum(full) - full
            out.append(pd.DataFrame({"source": pd.Series([source] * len(on), dtype=object), "shard": on, "first": first[on], "slots": full[on]}))
        return pd.concat(out, ignore_index=True)

    return grouped.groupBy("_group").applyInPandas(draw, "source string, shard long, first long, slots long")


def drawn_blocks(plan: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """plan (source, source_size, target) as the blocks that the mix takes: source, block, pass, shard, slot, words.

    Slot i of a source takes block p(i modulo blocks), with another permutation p in each pass. Whole passes take every block; the last
    one is cut to the words that its target leaves.
    """
    blocks = F.ceil(F.col("source_size") / block)
    size = plan.where("source_size > 0").withColumn("blocks", blocks).withColumn("whole", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    size = size.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    size = size.withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block))
    dealt = shard_counts(size, shards, seed).withColumn("_one", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096))))
    dealt = dealt.select("source", "shard", (F.col("first") + F.col("_one") * 4096).alias("first"), F.least(F.lit(4096).cast("long"), F.col("slots") - F.col("_one") * 4096).alias("n"))
    info = size.select(F.col("source").alias("_s"), "source_size", "blocks", "whole", "rest", F.col("slots").alias("all_slots"))
    dealt = dealt.join(info, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                source = None if pd.isna(r.source) else r.source
                slot = np.arange(r.first, r.first + r.n)
                turn = slot // r.blocks
                key = np.uint64(source_key(source, seed)) + turn.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
                at = permuted(slot % r.blocks, np.full(len(slot), r.blocks), key)
                words = np.minimum(block, r.source_size - at * block)
                words = np.where(slot == r.all_slots - 1, np.minimum(words, r.rest - (r.all_slots - 1 - r.whole * r.blocks) * block) if r.rest > 0 else words, words)
                yield pd.DataFrame({"source": pd.Series([source] * len(slot), dtype=object), "block": at, "pass": turn, "shard": r.shard, "slot": slot, "words": words})

    # a few rows stand for many blocks: dealt over all tasks by number, which adaptive execution leaves as it is
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "source", "first").mapInPandas(take, "source string, block long, pass long, shard long, slot long, words long")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most_times: float = 2.0, block: int = 256, shards: int | None = None, seed: int = 20240101, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, taken pieces). documents: doc_id, source, fp, size, source_size, target, start (its place in its source's stream of words).
    pieces: doc_id, source, start (tells rows with equal ids apart), block, pass, shard, slot, from_word, to_word: what a drawn block takes
    of a document, by word numbers from 0.

    A source's documents form one stream, in order of (bucket, doc_id, size, fp: a hash of the text); it is cut into blocks of ``block``
    words, the last one shorter. A document lies in size / block + 2 blocks at most, so the join by block index grows with the words, not
    with a source's size; sources of any size are dealt over buckets and blocks. There are 64 shards by default, or one for every 2^23
    words of the mix if that is more. Texts are null: size 0, never taken. A null source is a source. Other columns are not read.
    """
    whole = docs.select("doc_id", "source", F.xxhash64(text).alias("fp"), word_count(text).alias("size"))
    whole = written(running_total(whole, ["source"], ["doc_id", "size", "fp"], F.col("size"), "start"), "mix-sizes")
    sizes = whole.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(targets(sizes, weights, share, most_times), "mix-plan")
    if shards is None:
        shards = max(64, int((plan.agg(F.sum("target")).first()[0] or 0) // (1 << 23)))
    full = whole.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    lying = whole.where("size > 0").select("doc_id", "source", "size", "start", F.explode(F.sequence(first, last)).alias("block"))
    drawn = drawn_blocks(plan, block, shards, seed)
    drawn = drawn.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "pass", "shard", "slot", "words")
    # the drawn blocks come from a table of one row a source, whose size says nothing of theirs: never broadcast
    pieces = lying.join(drawn.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    at = F.col("block") * block
    lo, hi = F.greatest(F.col("start"), at) - F.col("start"), F.least(F.col("start") + F.col("size"), at + F.col("words")) - F.col("start")
    pieces = pieces.select("doc_id", "source", "start", "block", "pass", "shard", "slot", lo.alias("from_word"), hi.alias("to_word")).where("to_word > from_word")
    return full, pieces


def op3(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted), and shards (those
    whose drawn blocks hold words of it), a row for each row of docs.

    Null and empty texts have size 0 and are never taken; a null source is one source, last in order; rows with equal ids are documents
    of their own; other columns are not read, and an empty table gives no rows.
    """
    full, pieces = mix(docs, list(weights))
    taken = pieces.groupBy("doc_id", "source", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"), F.array_sort(F.collect_set("shard")).alias("_shards"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("start").alias("_t"), "_taken", "_shards")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_t")) & (F.col("size") > 0)
    return full.join(taken, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("_shards", F.array().cast("array<long>")).alias("shards"))


_WORD = re.compile(WORD)


def _cut(text: str, spans: np.ndarray) -> str:
    """The words of the spans [from, to), with the text between them, spans that touch joined."""
    at = [m.span() for m in _WORD.finditer(text)]
    out = []
    for lo, hi in spans:
        end = len(text) if hi >= len(at) else at[hi][0]
        out.append(text[0 if lo == 0 else at[lo][0] : end])
    return "".join(out)


@F.pandas_udf(StringType())
def _taken_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_cut(t, [(x["from_word"], x["to_word"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)


def _passes(docs: DataFrame, full: DataFrame, pieces: DataFrame) -> DataFrame:
    """docs with _size and _pass (pass; shard and slot, those of its first block; spans), a row for each pass that takes words of a document.

    Rows with equal doc_id, source and text stand for each other; their numbers deal the passes. Texts are shuffled once, by one key.
    """
    key = lambda fp: F.md5(F.concat_ws("\u0000", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")), fp.cast("string")))
    head = F.min(F.struct("from_word", "shard", "slot")).alias("_head")
    spans = pieces.groupBy("doc_id", "source", "start", "pass").agg(head, F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("start").alias("_t")).agg(F.array_sort(F.collect_list(F.struct(F.col("pass"), F.col("_head.shard").alias("shard"), F.col("_head.slot").alias("slot"), "spans"))).alias("_passes"))
    rows = full.where("size > 0").select("doc_id", "source", "start", key(F.col("fp")).alias("_key"))
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_t")), "left")
    rows = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "_passes"))).alias("_rows")).hint("merge")
    texts = docs.withColumn("_size", word_count()).withColumn("_key", key(F.xxhash64("text"))).where("_size > 0")
    texts = texts.withColumn("_no", F.row_number().over(Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_first() for c, k in docs.dtypes if c not in ("doc_id", "source", "text") and not k.startswith(("map", "variant"))] or [F.lit(0)])))
    return texts.join(rows, "_key").withColumn("_pass", F.explode(F.col("_rows")[F.col("_no") - 1]["_passes"])).select(*docs.columns, "_size", "_pass")


def mixed_documents(docs: DataFrame, weights: list[float], **how) -> DataFrame:
    """docs as the mix takes them, with the same columns: a row for each pass over a document, its text cut to the words taken in that
    pass (the whole text where all are taken), n_chars to match. Documents of which nothing is taken are absent.

    A row belongs to the shard that drew the pass's first block; shards lie together, and within a shard rows are in pseudorandom order,
    so that the files that come of it hold the mix.
    """
    def work(docs: DataFrame) -> DataFrame:
        full, pieces = mix(docs, weights, **how)
        rows = _passes(docs, full, pieces)
        taken = F.aggregate("_pass.spans", F.lit(0).cast("long"), lambda a, x: a + x["to_word"] - x["from_word"])
        rows = rows.repartition("_pass.shard").sortWithinPartitions("_pass.shard", F.xxhash64("source", "_pass.slot"), "_pass.pass", "doc_id")
        rows = rows.withColumn("_spans", F.when(taken < F.col("_size"), F.col("_pass.spans")))
        columns = [F.coalesce("_cut", "text").alias("text") if c == "text" else F.length(F.coalesce("_cut", "text")).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
        return rows.withColumn("_cut", F.when(F.col("_spans").isNotNull(), _taken_text("text", F.coalesce("_spans", F.array().cast("array<struct<from_word:bigint,to_word:bigint>>"))))).select(*columns)

    return shielded(docs, work)


def mixed_blocks(docs: DataFrame, weights: list[float], **how) -> DataFrame:
    """The mix itself: a row for each drawn block: shard, source, slot (the block's number among its source's slots), block, pass, n_words,
    text (of the documents that lie in the block, one after the other, with a line end between)."""
    full, pieces = mix(docs, weights, **how)
    one = pieces.select("doc_id", "source", "start", "block", "pass", "shard", "slot", F.array(F.struct("from_word", "to_word")).alias("_spans"))
    texts = docs.select("doc_id", "source", F.xxhash64("text").alias("fp"), "text").dropDuplicates(["doc_id", "source", "fp"])
    where = full.where("size > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("start").alias("_t"), F.col("fp").alias("_f"))
    one = one.join(where, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_t"))).drop("doc_id", "source")
    cut = texts.join(one, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("fp") == F.col("_f"))).select("shard", "source", "slot", "block", "pass", "start", "_spans", _taken_text("text", "_spans").alias("_text"))
    words = F.col("_spans")[0]["to_word"] - F.col("_spans")[0]["from_word"]
    blocks = cut.groupBy("shard", "source", "slot", "block", "pass").agg(F.sum(words).alias("n_words"), F.array_sort(F.collect_list(F.struct("start", "_text"))).alias("_all"))
    return blocks.select("shard", "source", "slot", "block", "pass", "n_words", F.array_join(F.transform("_all", lambda x: x["_text"]), "\n").alias("text"))
