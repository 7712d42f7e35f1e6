"""The named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import detectors, marts, others, raw, streams

FLAGSHIP = "run_detection"
GROUPS = [marts, detectors, others, raw, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for group in GROUPS for name, text in group.SQL.items()}
