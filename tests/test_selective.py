"""Laid out tables: the same rows as a filter of the whole, and what the scan read for them."""

import random

import pytest
from pyspark.sql import functions as F

from fiscalens.operators import selective


def scanned(df):
    """df's rows, and how many the scans under it gave."""
    rows = df.collect()
    todo, read = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            read += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, read


@pytest.mark.parametrize("text", [False, True])
def test_few_keys_skip_row_groups(spark, tmp_path, text):
    n, kinds = 400_000, 200_000
    key = (F.xxhash64("id") % kinds).alias("key")
    df = spark.range(n).select(key.cast("string").alias("key") if text else key, "id", F.sha2(F.col("id").cast("string"), 256).alias("more"))
    path = str(tmp_path / "t")
    selective.lay_out(df, path, "key", group_bytes=64 << 10)
    stray = [random.Random(1).randrange(-kinds, kinds) for _ in range(20)]
    keys = spark.createDataFrame([(str(x) if text else x,) for x in [*stray, *stray, None]], df.select("key").schema)
    got, read = scanned(selective.rows_of(spark, path, keys, "key"))
    want = df.join(keys.dropDuplicates(), "key", "left_semi").collect()
    assert sorted(got) == sorted(want) and got
    assert read < n / 10, read
    # beyond the bound, and without any key: the same rows by another way
    assert sorted(selective.rows_of(spark, path, keys, "key", most_keys=3).collect()) == sorted(want)
    assert selective.rows_of(spark, path, keys.where("key is null"), "key").collect() == []


def test_a_hot_key_lies_in_many_files(spark, tmp_path):
    df = spark.range(0, 30_000, 1, 64).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"), F.lit("x").alias("same"))
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        selective.lay_out(df, path, "key")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(path)
    assert table.where("key = 7").select(F.input_file_name()).distinct().count() > 1
    assert selective.rows_of(spark, path, spark.createDataFrame([(7,)], "key long"), "key").count() == 10_000 + 1


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "key long, `a.b` string")
    selective.lay_out(empty, str(tmp_path / "e"), "key")
    keys = spark.createDataFrame([(1,)], "key long")
    assert selective.rows_of(spark, str(tmp_path / "e"), keys, "key").columns == ["key", "a.b"]
    assert selective.rows_of(spark, str(tmp_path / "e"), keys, "key").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "key long, `a.b` string")
    selective.lay_out(nulls, str(tmp_path / "n"), "key")
    assert selective.rows_of(spark, str(tmp_path / "n"), keys, "key").collect() == [(1, None), (1, None)]
    assert spark.read.parquet(str(tmp_path / "n")).count() == 3
    with pytest.raises(ValueError, match="_h"):
        selective.lay_out(empty.withColumn("_h", F.lit(1)), str(tmp_path / "c"), "key")
