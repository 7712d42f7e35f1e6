"""A stored index of texts: posting lists in blocks of documents with their greatest counts, so that a search for the best reads few blocks;
documents are added, replaced and deleted by segment."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.storage import new_folder, written

#: Folders that a word's lists may lie in.
BUCKETS = 64
#: What rounding to six decimals and the order of sums may add to a score.
SLACK = 2e-6


class Found(NamedTuple):
    """rows: doc_id, score, best first. blocks, postings: those of the query's words; read, postings_read: those that were looked into."""

    rows: DataFrame
    blocks: int
    read: int
    postings: int
    postings_read: int


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _blocked(df: DataFrame, size: Column, block: int) -> tuple[DataFrame, int, int]:
    """df with the block of each doc_id, by size and hash, and the numbers of rows and blocks. Like sizes lie together, so that large counts
    meet in few blocks; a block has about ``block`` rows."""
    kind = F.floor(F.log2(size + 1)).cast("long")
    counts = {r.kind: r.n for r in df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 kinds at most
    if not counts:
        return df.withColumn("block", F.lit(0).cast("long")), 0, 0
    many = {k: max(1, math.ceil(n / block)) for k, n in counts.items()}
    of_kind = F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair])
    return df.withColumn("block", kind * F.lit(1 << 40) + F.pmod(F.xxhash64("doc_id"), of_kind[kind])), sum(counts.values()), sum(many.values())


def _words(docs: DataFrame, block: int) -> tuple[DataFrame, int, int]:
    """A row a document: doc_id, words (word, tf), block; and the numbers of documents and blocks. Texts move once, to their block; words are
    counted and gathered there."""
    whole = F.concat_ws(" ", "title", "text") if "title" in docs.columns else F.coalesce("text", F.lit(""))
    texts = docs.where("doc_id is not null").select("doc_id", whole.alias("_whole"))
    n = texts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n.rows != n.ids:
        texts = texts.groupBy("doc_id").agg(F.array_join(F.collect_list("_whole"), " ").alias("_whole"))
    placed, many, blocks = _blocked(texts, F.octet_length("_whole"), block)
    words = F.filter(F.split(F.lower(F.col("_whole")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = placed.repartition("block").select("block", "doc_id", F.explode_outer(words).alias("word")).groupBy("block", "doc_id", "word").agg(F.count("word").alias("tf"))
    return counted.groupBy("block", "doc_id").agg(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "tf"))).alias("words")).select("doc_id", "words", "block"), many, blocks


def _kind(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/kind").schema["doc_id"].dataType.simpleString()


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A part of the index, its committed segments only."""
    kind = _kind(spark, path)
    schema = {
        "docs": f"doc_id {kind}, words array<struct<word:string,tf:bigint>>, block bigint, seg string",
        "postings": f"word string, block bigint, n bigint, max_tf bigint, docs array<struct<doc_id:{kind},tf:bigint>>, seg string, bucket int",
        "words": "word string, df bigint, seg string, bucket int",
        "gone": f"doc_id {kind}, seg string",
    }[name]
    done = [r.seg for r in segments(spark, path).select("seg").collect()]  # a row a segment; merged() makes one of them
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("seg").isin(done))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments that count: seg, n (documents added less those deleted or replaced), blocks."""
    try:
        return spark.read.schema("seg string, n long, blocks long").parquet(f"{path}/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "seg string, n long, blocks long")


def _opened(spark: SparkSession, path: str) -> None:
    """Folders of the tables, with a segment that never counts, so that all can be read from the start."""
    for name in ("docs/seg=none", "gone/seg=none", "postings/seg=none/bucket=-1", "words/seg=none/bucket=-1"):
        spark.createDataFrame([], "x int").write.parquet(f"{path}/{name}")


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The documents that stand: what a later segment deleted or replaced does not."""
    docs, gone = _table(spark, path, "docs"), _table(spark, path, "gone").select(F.col("doc_id").alias("_id"), F.col("seg").alias("_seg"))
    return docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("seg") < F.col("_seg")), "left_anti")


def _commit(spark: SparkSession, path: str, new: tuple[DataFrame, int, int] | None, gone: DataFrame | None) -> None:
    """A segment: new documents as of _words and those that go (doc_id, words). It counts once its row in ``done`` is written."""
    seg = f"{segments(spark, path).count():08d}-{uuid.uuid4().hex}"
    named = lambda df: df.withColumn("seg", F.lit(seg))
    changes, n, blocks = [], 0, 0
    if gone is not None:
        gone = written(gone.select("doc_id", "words"), "index-gone")
        n -= gone.count()
        named(gone.select("doc_id")).write.mode("append").partitionBy("seg").parquet(f"{path}/gone")
        changes.append(gone.select(F.explode("words.word").alias("word"), F.lit(-1).cast("long").alias("df")))
    if new is not None:
        rows, many, blocks = new
        n += many
        named(rows).write.mode("append").partitionBy("seg").parquet(f"{path}/docs")
        docs = spark.read.schema(named(rows).schema).parquet(f"{path}/docs").where(F.col("seg") == seg)
        # buckets of words fall into slices, so that a frequent word's lists are not one task's
        slice_ = F.pmod(F.xxhash64("block", F.lit(7)), F.lit(1 + many // 2_000_000)).cast("int")
        one = docs.select("doc_id", "block", F.inline("words")).select("word", "block", "doc_id", "tf", _bucket(F.col("word")).alias("bucket"), slice_.alias("_slice"))
        by = ["bucket", "_slice", "word", "block"]
        lists = one.repartition("bucket", "_slice").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("docs"))
        lists = named(lists.sortWithinPartitions("bucket", "word", "block").drop("_slice"))
        lists.select("word", "block", "n", "max_tf", "docs", "seg", "bucket").write.mode("append").partitionBy("seg", "bucket").parquet(f"{path}/postings")
        stored = spark.read.schema("word string, n long, seg string").parquet(f"{path}/postings").where(F.col("seg") == seg)
        changes.append(stored.select("word", F.col("n").alias("df")))
    summed = reduce(DataFrame.unionByName, changes).groupBy("word").agg(F.sum("df").alias("df")).where("df <> 0")
    summed = named(summed).withColumn("bucket", _bucket(F.col("word")))
    summed.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("append").partitionBy("seg", "bucket").parquet(f"{path}/words")
    spark.createDataFrame([(seg, n, blocks)], "seg string, n long, blocks long").coalesce(1).write.mode("append").parquet(f"{path}/done")


def build(docs: DataFrame, path: str | None = None, block: int = 1024) -> str:
    """The folder of an index of documents (doc_id, text, and title if they have one) with words as text_search takes them.

    Rows of one doc_id are one document; a null doc_id is no document; a null or empty text has no words, but counts as a document. A list
    holds one word's documents of one block, about ``block`` documents of like length, so that no list grows with the corpus, and no word's
    lists are one task's.
    """
    path = path or new_folder(docs.sparkSession, "text-index")
    docs.select("doc_id").limit(0).write.parquet(f"{path}/kind")
    _opened(docs.sparkSession, path)
    _commit(docs.sparkSession, path, _words(docs, block), None)
    return path


def add(path: str, docs: DataFrame, block: int = 1024) -> None:
    """Documents into the index, in place of those of the same doc_id. One writer at a time; a failed one leaves the index as it was."""
    spark = docs.sparkSession
    _commit(spark, path, _words(docs, block), _live(spark, path).join(docs.select("doc_id"), "doc_id", "left_semi"))


def delete(path: str, keys: DataFrame) -> None:
    """Documents (doc_id) out of the index; unknown ones change nothing. Their own words are read, no lists."""
    spark = keys.sparkSession
    _commit(spark, path, None, _live(spark, path).join(keys.select("doc_id"), "doc_id", "left_semi"))


def merged(spark: SparkSession, path: str, to: str | None = None, block: int = 1024) -> str:
    """The folder of an index of one segment with the documents that stand; texts are not read again."""
    to = to or new_folder(spark, "text-index")
    spark.read.parquet(f"{path}/kind").write.parquet(f"{to}/kind")
    _opened(spark, to)
    live = _live(spark, path).select("doc_id", "words")
    _commit(spark, to, _blocked(live, F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["tf"]), block), None)
    return to


def search(spark: SparkSession, path: str, query: list[str], top_k: int = 20, first: int = 8) -> Found:
    """The ``top_k`` documents by the sum of tf * ln(N / df), ties by id: what text_search finds among the documents that stand.

    A block's documents score at most the sum of its words' greatest counts times their weights; deletions only lower it. The ``first``
    blocks by this bound are read, then all whose bound reaches the last of the best found there; no other can hold a better one. Of the
    lists, bounds are read for the query's words, documents for the blocks taken.
    """
    kind = _kind(spark, path)
    asked = sorted({w.lower() for w in query})
    totals = segments(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    of = lambda df: df.where(F.col("word").isin(asked) & F.col("bucket").isin([r[0] for r in keys]))
    keys = spark.createDataFrame([(w,) for w in asked] or [("",)], "w string").select(_bucket(F.col("w"))).distinct().collect()
    weights = of(_table(spark, path, "words")).groupBy("word").agg(F.sum("df").alias("df")).where("df > 0").select("word", F.log(F.lit(totals.n) / F.col("df")).alias("_idf"))
    weights = F.broadcast(spark.createDataFrame(weights.collect(), "word string, _idf double"))  # a row a word of the query
    lists = of(_table(spark, path, "postings"))
    bounds = written(lists.select("seg", "block", "word", "n", "max_tf").join(weights, "word").groupBy("seg", "block").agg(F.sum(F.col("max_tf") * F.col("_idf")).alias("bound"), F.sum("n").alias("n")), "index-bounds")
    gone = _table(spark, path, "gone").select(F.col("doc_id").alias("_id"), F.col("seg").alias("_seg"))

    def best(blocks: DataFrame) -> list:
        hits = lists.select("seg", "block", "word", "docs").join(blocks.select("seg", "block"), ["seg", "block"], "left_semi").join(weights, "word").select("seg", "_idf", F.inline("docs"))
        hits = hits.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("seg") < F.col("_seg")), "left_anti")
        return hits.groupBy("doc_id").agg(rounded(F.sum(F.col("tf") * F.col("_idf")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top_k).collect()

    some = written(bounds.orderBy(F.desc("bound"), "seg", "block").limit(first), "index-first")
    rows = best(some)
    rest = bounds.join(some.select("seg", "block"), ["seg", "block"], "left_anti")
    if len(rows) == top_k:
        rest = rest.where(F.col("bound") >= F.lit(rows[-1].score - SLACK))
    size = F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    whole, one, two = bounds.agg(*size).first(), some.agg(*size).first(), rest.agg(*size).first()
    if two.blocks:
        rows = sorted([*rows, *best(rest)], key=lambda r: (-r.score, r.doc_id))[:top_k]
    return Found(spark.createDataFrame([tuple(r) for r in rows], f"doc_id {kind}, score double"), whole.blocks, one.blocks + two.blocks, whole.n, one.n + two.n)
