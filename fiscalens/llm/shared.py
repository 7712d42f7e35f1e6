"""Shared folder, written tables and running totals used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of a text: a run of characters that are neither a space nor \t to \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, but only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fiscalens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """df, written, with out: each row's place in the order, from 0. Rows are dealt by sampled ranges; only the counts of the tasks, a row
    each, meet in one window."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    tasks = dealt.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_from"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    tasks = tasks.select("_task", "_from", (F.sum("_rows").over(before) - F.col("_rows")).alias("_base"))
    return dealt.join(tasks, "_task").withColumn(out, F.col("_base") + F.col("_at") - F.col("_from")).drop("_task", "_at", "_from", "_base")


#: Rows of a group that one task sums.
BUCKET_ROWS = 1 << 18


def running_total(df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, buckets: int | None = None) -> DataFrame:
    """df with out: the sum of weight over the rows before this one in its group, whose rows stand in order of (bucket, *order).

    The bucket is a hash of the columns of the order, so that rows of one key, null or not, are dealt apart where they differ in another.
    There are 251 buckets, or one for every BUCKET_ROWS rows of df if that is more: each bucket of a group is summed in one task, and
    only the buckets' totals meet. The weight must not be null.
    """
    bucket, base, total = "_bucket", "_base", "_total"
    buckets = buckets or max(251, -(-df.count() // BUCKET_ROWS))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_weight", weight.cast("long"))
    within = Window.partitionBy(*group, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(out, F.sum("_weight").over(within) - F.col("_weight"))
    totals = df.groupBy(*group, bucket).agg(F.sum("_weight").alias(total))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    bases = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col(bucket).alias("_g_bucket"), (F.sum(total).over(before) - F.col(total)).alias(base))
    same = F.col(bucket) == F.col("_g_bucket")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(bases, same)
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(bucket, base, "_weight", "_g_bucket", *[f"_g_{c}" for c in group])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows at most, as whole texts are large; a session's own smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """work(docs), which gives docs' columns in their order, with columns other than a document's under names of no meaning meanwhile, so
    that none can clash with the operator's own."""
    safe = [c if c in keep else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*safe)).toDF(*docs.columns)
