"""Large tables laid out so that the rows of some thousand keys are read without the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reviews import selected


def lay_out(df: DataFrame, path: str, key: str, most_keys: int = 5000, group_bytes: int = 16 << 20) -> None:
    """Write df as Parquet in the order of a key, in row groups of ``group_bytes`` whose Bloom filters answer for ``most_keys`` keys at once.

    A filter is asked for every key, so one that errs once in a hundred would keep nearly all groups when 5000 are asked for. Its share of
    errors is therefore a hundredth over ``most_keys``: some 4 bytes for each different key of a group, and a group without any of the keys
    is read once in a hundred. Parquet leaves a filter out where a group's dictionary holds all its keys; the dictionary then answers.

    Files are ranges of (key, hash of the row, place read), so a key of a third of all rows, or a row that is repeated as often, is dealt to
    many tasks (equal rows as far as they came from several); AQE sets their number by size. Rows without the key are kept in the table. An existing folder is an error.
    """
    clash = {"_h", "_p"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names that the layout needs")
    dealt = df.withColumns({"_h": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), "_p": F.spark_partition_id()})
    sorted_rows = dealt.repartitionByRange(F.col(f"`{key}`"), "_h", "_p").sortWithinPartitions(F.col(f"`{key}`")).drop("_h", "_p")
    bloom = {"enabled": "true", "fpp": repr(0.01 / most_keys), "adaptive.enabled": "true", "max.bytes": str(group_bytes)}
    options = {f"parquet.bloom.filter.{k}#{key}" if k in ("enabled", "fpp") else f"parquet.bloom.filter.{k}": v for k, v in bloom.items()}
    sorted_rows.write.options(**options, **{"parquet.block.size": str(group_bytes)}).parquet(path)


def rows_of(spark: SparkSession, path: str, keys: DataFrame, key: str, most_keys: int = 5000) -> DataFrame:
    """The rows of a laid out table whose key is asked for, whole. NULLs ask for nothing; keys may repeat.

    Up to ``most_keys`` keys go to the scan as one list, by which it skips row groups (their statistics, dictionaries and Bloom filters);
    more are a semi join, whose result is the same. The driver holds ``most_keys`` + 1 keys at most.
    """
    table = spark.read.parquet(path)
    asked = keys.select(key).where(F.col(f"`{key}`").isNotNull()).distinct()
    few = [r[0] for r in asked.limit(most_keys + 1).collect()]
    return table.where(F.col(f"`{key}`").isin(few)) if len(few) <= most_keys else selected(table, asked, key)
