"""Rounding whose ties do not depend on how a double falls: half up, of the value to ten places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    return F.round(x.cast("double").try_cast("decimal(38,10)"), places).cast("double")


def rounded_sql(x: str, places: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {places}) AS DOUBLE)"
