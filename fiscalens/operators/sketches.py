"""Profiles by batch as sketches that merge, so that metrics of any set of batches need no rescan of their rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.rounding import rounded

#: Quantiles are within this share of the value at their rank.
RELATIVE = 0.01
#: Registers of the sketch of different values: 2^12, a standard error of 1.6 %.
REGISTERS = 12
SCHEMA = "column_name string, is_number boolean, n long, nulls long, numbers long, lowest double, highest double, mean double, m2 double, buckets map<int,bigint>, seen binary, batch string"
_FIELDS = [x.split(" ")[0] for x in SCHEMA.split(", ")]


def _offset(relative: float) -> int:
    """More than the logarithm to the bucket's base of any double."""
    return math.ceil(746 / _log_base(relative))


def _log_base(relative: float) -> float:
    return math.log((1 + relative) / (1 - relative))


def bucket_of(x: Column, relative: float = RELATIVE) -> Column:
    """The number of the range that a finite double is in; ranges rise with their values, 0 holds zero alone."""
    size = F.ceil(F.ln(F.abs(x)) / F.lit(_log_base(relative))) + F.lit(_offset(relative))
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("int")


def value_of(bucket: Column, relative: float = RELATIVE) -> Column:
    """A value that is within ``relative`` of all in the range."""
    base = math.exp(_log_base(relative))
    size = F.exp((F.abs(bucket) - _offset(relative)) * F.lit(_log_base(relative))) * F.lit(2 / (base + 1))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, columns: list[str], batch: Column, relative: float = RELATIVE) -> DataFrame:
    """A row a batch and column: n, nulls, numbers (finite ones), lowest, highest, mean and squared deviations of these, counts by range of
    values, and a sketch of the different values. One pass over df; rows are summed before they are shuffled, and a batch of any size is
    some thousand ranges, so that neither a large batch nor a frequent value is one task's work.

    NaN and infinite values count in n, not in numbers. A column without numbers has no ranges. A NULL batch is the batch ''. An empty table
    gives no rows. Columns may have any names.
    """
    numeric = {c for c in columns if isinstance(df.schema[c].dataType, NumericType)}
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), F.lit(c in numeric).alias("is_number"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("x"))
    long = df.select(F.coalesce(batch.cast("string"), F.lit("")).alias("batch"), F.explode(F.array(*[cell(c) for c in columns])).alias("c")).select("batch", "c.*")
    long = long.withColumn("x", F.when(F.isnan("x") | (F.abs("x") == float("inf")), None).otherwise(F.col("x"))).withColumn("bucket", bucket_of(F.col("x"), relative))
    # the sketch leaves empty texts out, so values carry a sign
    ranges = long.groupBy("batch", "column_name", "is_number", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count("x").alias("numbers"), F.min("x").alias("lowest"), F.max("x").alias("highest"),
        F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.hll_sketch_agg(F.concat(F.lit("="), "text"), REGISTERS).alias("seen"))
    return _summed(ranges, ["batch"], F.when(F.col("bucket").isNotNull(), F.map_from_arrays(F.array("bucket"), F.array("numbers")))).select(*_FIELDS)


def _summed(parts: DataFrame, by: list[str], buckets: Column) -> DataFrame:
    """Parts of a column as one row, by the columns ``by``; squared deviations add up with those of the parts' means."""
    keys = [*by, "column_name", "is_number"]
    parts = parts.withColumn("buckets", buckets)
    sums = parts.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in ("n", "nulls", "numbers")], F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        (F.sum(F.col("mean") * F.col("numbers")) / F.nullif(F.sum("numbers"), F.lit(0))).alias("mean"), F.hll_union_agg("seen").alias("seen"))
    counts = parts.select(*keys, F.explode("buckets").alias("bucket", "count")).groupBy(*keys, "bucket").agg(F.sum("count").alias("count"))
    counts = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "count")))).alias("buckets"))
    apart = parts.join(sums.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(F.sum(F.col("m2") + F.col("numbers") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("m2"))
    return sums.join(counts, keys, "left").join(apart, keys, "left")


def merged(sketches: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """Sketches of many batches as one a column, or one a column and value of ``by`` (names and expressions of the batch; names of the
    sketches' other fields are an error). NULLs of an expression are ''."""
    by = by or {}
    if set(by) & (set(_FIELDS) - {"batch"}):
        raise ValueError(f"{sorted(set(by) & set(_FIELDS))}: the sketches have such fields")
    keyed = sketches.select(*[F.coalesce(x.cast("string"), F.lit("")).alias(k) for k, x in by.items()], *[c for c in sketches.columns if c not in by])
    return _summed(keyed, list(by), F.col("buckets"))


def quantile(part: float, relative: float = RELATIVE) -> Column:
    """The value at rank floor(part * (numbers - 1)) of a sketch: within ``relative`` of the exact one, and between lowest and highest."""
    at = F.floor(F.lit(float(part)) * (F.col("numbers") - 1))
    entries = F.array_sort(F.map_entries("buckets"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
    found = F.aggregate(entries, start, lambda a, e: F.struct((a["seen"] + e["value"]).alias("seen"), F.when(a["bucket"].isNotNull(), a["bucket"]).when(a["seen"] + e["value"] > at, e["key"]).alias("bucket")))
    return F.when(F.col("numbers") > 0, F.greatest("lowest", F.least("highest", value_of(found["bucket"], relative))))


def profiles(merged_sketches: DataFrame, relative: float = RELATIVE) -> DataFrame:
    """Merged sketches in the form of quality.profile, which quality_score, profile_alerts and monitor take: mode is not known, distinct
    values are estimated, and ranges that lie beyond a fence as a whole are outliers. The columns that the sketches are merged by stay."""
    by = [c for c in merged_sketches.columns if c not in set(_FIELDS) - {"batch"}]
    x = merged_sketches.withColumns({f"q{i}": quantile(i / 4, relative) for i in (1, 2, 3)} | {"distinct_values": F.when(F.col("n") > F.col("nulls"), F.hll_sketch_estimate("seen")).otherwise(0)})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    size = lambda e: F.abs(value_of(e["key"], relative)) * (relative * 1.000001)
    outside = lambda e: (value_of(e["key"], relative) + size(e) < F.col("q1") - reach) | (value_of(e["key"], relative) - size(e) > F.col("q3") + reach)
    beyond = F.aggregate(F.filter(F.map_entries("buckets"), outside), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    share = lambda y: rounded(F.coalesce(F.col(y) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))
    return x.select(*by, "column_name", "n", "nulls", share("nulls").alias("nulls_share"), "distinct_values", share("distinct_values").alias("distinct_share"), "lowest", "highest", rounded(F.col("mean")).alias("mean"), rounded(F.col("q2")).alias("median"),
                    rounded(F.sqrt(F.col("m2") / F.nullif(F.col("numbers") - 1, F.lit(0)))).alias("deviation"), rounded(F.col("q1")).alias("q1"), rounded(F.col("q3")).alias("q3"), F.coalesce(beyond, F.lit(0).cast("long")).alias("outliers"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("long").alias("mode_count"))


def store(sketches: DataFrame, path: str) -> None:
    """Add sketches to a folder, one subfolder a batch; a batch that is there already is replaced, so that one tried again counts once."""
    sketches.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The sketches of a folder, of the batches from ``since`` on (in the order of their names) if it is given; the others are not read."""
    found = spark.read.schema(SCHEMA).parquet(path).withColumn("batch", F.when(F.col("batch").isNull(), F.lit("")).otherwise(F.col("batch")))
    return found if since is None else found.where(F.col("batch") >= since)
