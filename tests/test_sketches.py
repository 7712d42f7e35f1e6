"""Sketches by batch against exact profiles of the same rows."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fiscalens.operators import quality as Q
from fiscalens.operators import sketches as K


def lower(values, part):
    return sorted(values)[math.floor(part * (len(values) - 1))]


def test_merged_sketches_keep_their_bounds(spark, tmp_path):
    draw = random.Random(3)
    rows = [(f"2024-{1 + i % 6:02d}", None if i % 11 == 0 else draw.choice([draw.lognormvariate(8, 3), -draw.random(), 0.0, 1e-7, 5e11]), f"k{draw.randrange(3000)}", i // 6 % 3) for i in range(9000)]
    df = spark.createDataFrame(rows, "month string, `a.b` double, word string, n int")
    path, columns = str(tmp_path / "s"), ["a.b", "word", "n"]
    early = df.where("month < '2024-05'")
    K.store(K.sketch(early, columns, F.col("month")), path)
    K.store(K.sketch(df.where("month >= '2024-04'"), columns, F.col("month")), path)  # April once more
    for since in (None, "2024-03", "2024-06"):
        got = {r.column_name: r for r in K.profiles(K.merged(K.stored(spark, path, since))).collect()}
        some = [r for r in rows if since is None or r[0] >= since]
        numbers = [r[1] for r in some if r[1] is not None]
        x, w = got["a.b"], got["word"]
        assert (x.n, x.nulls, x.lowest, x.highest) == (len(some), len(some) - len(numbers), min(numbers), max(numbers))
        mean = math.fsum(numbers) / len(numbers)
        assert math.isclose(x.mean, mean, rel_tol=1e-9)
        assert math.isclose(x.deviation, math.sqrt(math.fsum((v - mean) ** 2 for v in numbers) / (len(numbers) - 1)), rel_tol=1e-9)
        for found, part in ((x.q1, 0.25), (x.median, 0.5), (x.q3, 0.75)):
            exact = lower(numbers, part)
            assert abs(found - exact) <= K.RELATIVE * abs(exact) + 1e-4, (since, part)
        different = len({r[2] for r in some})
        assert abs(w.distinct_values - different) <= 4 * 0.0163 * different and w.nulls == 0 and w.q1 is None and w.outliers == 0
        assert got["n"].distinct_values == 3
        reach = 1.5 * (x.q3 - x.q1)
        assert abs(x.outliers - sum(not x.q1 - reach <= v <= x.q3 + reach for v in numbers)) <= sum(min(abs(v - f) for f in (x.q1 - reach, x.q3 + reach)) <= 2.1 * K.RELATIVE * abs(v) for v in numbers)
    # by a value of the batch, and into the monitor
    halves = K.profiles(K.merged(K.stored(spark, path), {"half": F.when(F.col("batch") < "2024-04", 1).otherwise(2)})).where("column_name = 'a.b'").collect()
    assert {r.half: r.n for r in halves} == {"1": 4500, "2": 4500}
    assert [r.metric for r in Q.monitor(K.profiles(K.merged(K.stored(spark, path))), "t", most_nulls=0.05).collect()] == ["a.b:nulls_pct"]


def test_quantiles_at_every_rank(spark):
    values = [-1e300, -5.0, -5.0, -0.25, 0.0, 0.0, 1e-300, 0.5, 1.0, 7.0, 7.0, 1e300]
    m = K.merged(K.sketch(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], F.lit("a")))
    parts = [i / (len(values) - 1) for i in range(len(values))]
    got = list(m.select(*[K.quantile(p) for p in parts]).first())
    for g, p in zip(got, parts, strict=True):
        exact = lower(values, p)
        assert abs(g - exact) <= K.RELATIVE * 1.000001 * abs(exact), (p, g, exact)


def test_odd_tables(spark, tmp_path):
    schema = "batch string, x double, word string"
    assert K.sketch(spark.createDataFrame([], schema), ["x", "word"], F.col("batch")).collect() == []
    rows = [(None, None, None), (None, float("nan"), None), ("b", float("inf"), ""), ("b", 2.0, "w" * 100_000), ("b", 2.0, "w" * 100_000)]
    path = str(tmp_path / "s")
    K.store(K.sketch(spark.createDataFrame(rows, schema), ["x", "word"], F.col("batch")), path)
    by = defaultdict(dict)
    for r in K.profiles(K.merged(K.stored(spark, path), {"batch": F.col("batch")})).collect():
        by[r.batch][r.column_name] = r
    assert by[""]["x"].n == 2 and by[""]["x"].nulls == 1 and by[""]["x"].median is None and by[""]["x"].mean is None
    assert by[""]["word"].nulls == 2 and by[""]["word"].distinct_values == 0
    assert (by["b"]["x"].n, by["b"]["x"].lowest, by["b"]["x"].highest, by["b"]["x"].median, by["b"]["x"].deviation) == (3, 2.0, 2.0, 2.0, 0.0)
    assert by["b"]["x"].outliers == 0  # one value, in one range
    assert by["b"]["word"].distinct_values == 2
    with pytest.raises(ValueError, match="nulls"):
        K.merged(K.stored(spark, path), {"nulls": F.col("batch")})
