"""The stored index of texts against a scan."""

import random

from pyspark.sql import functions as F

from fiscalens.operators import text as T
from fiscalens.operators import text_index as X

SCHEMA = "doc_id long, text string"


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = [words[min(59, int(rng.paretovariate(0.6)))] for _ in range(rng.choice([0, 1, 5, 30, 200]))]
        out.append((i, None if i % 41 == 7 else " ".join(text)))
    return out


def same(spark, path, rows, query, top_k=20, **how):
    found = X.search(spark, path, query, top_k, **how)
    want = T.text_search(spark.createDataFrame(rows, SCHEMA), query, top_k).collect()
    assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in want], query
    return found


def test_index_finds_what_a_scan_finds_after_adds_and_deletes(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKETS", 4)
    rng = random.Random(3)
    rows = corpus(rng, 300)
    path = X.build(spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("w1"), "seg": F.lit(1), "block": F.lit(2)}), block=10)
    for query, first in ((["W40", "w2"], 1), (["w1"], 8), (["w59", "w3", "w3"], 1), (["nowhere"], 8), ([], 8)):
        same(spark, path, rows, query, first=first)
    found = same(spark, path, rows, ["w30", "w45"], top_k=3, first=2)
    assert found.read < found.blocks and found.postings_read < found.postings
    X.delete(path, spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(10_000,), (None,)], "doc_id long"))
    changed = {i: t for i, t in rows if i % 7}
    same(spark, path, sorted(changed.items()), ["w40", "w2"])
    new = [(i, " ".join(["w40"] * (i % 5 + 1) + ["w2"])) for i in (*range(0, 40), *range(400, 420))]
    X.add(path, spark.createDataFrame(new, SCHEMA), block=10)
    changed |= dict(new)
    same(spark, path, sorted(changed.items()), ["w40", "w2"], top_k=7)
    X.delete(path, spark.createDataFrame([(410,), (3,)], "doc_id long"))
    X.add(path, spark.createDataFrame([(3, "w40 w41")], SCHEMA))
    del changed[410]
    changed[3] = "w40 w41"
    same(spark, path, sorted(changed.items()), ["w40", "w41"])
    one = X.merged(spark, path, block=16)
    assert X.segments(spark, one).count() == 1
    same(spark, one, sorted(changed.items()), ["w40", "w2", "w41"])


def test_a_segment_counts_once_it_is_committed(spark):
    rows = [(1, "a b"), (2, "a a c"), (3, "")]
    path = X.build(spark.createDataFrame(rows, SCHEMA))
    whole = spark.createDataFrame([(9, "a a a a")], SCHEMA)
    writer = spark.createDataFrame([], "seg string, n long, blocks long").write.__class__
    parquet, seen = writer.parquet, []

    def fails(self, to, *rest, **more):
        seen.append(to)
        if to.endswith("/done"):
            raise OSError("lost")
        return parquet(self, to, *rest, **more)

    writer.parquet = fails
    try:
        X.add(path, whole)
        raise AssertionError("the write did not fail")
    except OSError:
        pass
    finally:
        writer.parquet = parquet
    assert any("/postings" in x for x in seen)
    same(spark, path, rows, ["a", "c"])
    X.add(path, whole)
    same(spark, path, [*rows, (9, "a a a a")], ["a", "c"])


def test_repeated_ids_empty_tables_and_titles(spark):
    empty = X.build(spark.createDataFrame([], SCHEMA))
    assert X.search(spark, empty, ["a"]).rows.count() == 0
    X.add(empty, spark.createDataFrame([(1, "a"), (1, "a b"), (None, "a"), (2, "ç é")], SCHEMA))
    found = X.search(spark, empty, ["a", "É"]).rows.collect()
    assert [(r.doc_id, r.score) for r in found] == [(1, round(2 * 0.6931471805599453, 6)), (2, round(0.6931471805599453, 6))]
    titled = spark.createDataFrame([(1, "x", "tax"), (2, "tax tax", None)], "doc_id long, text string, title string")
    path = X.build(titled)
    assert X.search(spark, path, ["x"]).rows.first().doc_id == 1
