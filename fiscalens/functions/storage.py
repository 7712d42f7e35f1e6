"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but only if driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = (spark.sparkContext.applicationId, "", "")
    if key not in _stored:
        _stored[key] = tempfile.mkdtemp(prefix="fiscalens-")
    return _stored[key]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: made once, however many branches read it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives for a source, written by the first query of a session that asks for it, and again if it is gone."""
    key = (spark.sparkContext.applicationId, source, name)
    if key in _stored:
        try:
            return spark.read.parquet(_stored[key])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    path = new_folder(spark, name)
    make().write.parquet(path)
    _stored[key] = path
    return spark.read.parquet(path)
