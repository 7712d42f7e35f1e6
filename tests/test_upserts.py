"""Upserts by versions: what readers see, and what a failure leaves."""

import pytest

from fiscalens.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    path, make = str(tmp_path / "t"), lambda x: spark.createDataFrame(x, "id long, v string")
    with pytest.raises(FileNotFoundError):
        files.current(spark, path)
    assert files.upsert(spark, make([(i, f"a{i}") for i in range(40)]), path, "id", buckets=4) == 0
    open_before = files.current(spark, path)
    kind = type(spark.range(1).write)
    parquet = kind.parquet
    for step in ("/data", "/commits"):  # the data lie there whole when the commit is lost
        def lost(self, to, *rest, **more):
            if to == f"{path}{step}":
                if step == "/data":
                    parquet(self, to, *rest, **more)
                raise OSError("lost")
            return parquet(self, to, *rest, **more)

        with monkeypatch.context() as m:
            m.setattr(kind, "parquet", lost)
            with pytest.raises(OSError, match="lost"):
                files.upsert(spark, make([(i, "b") for i in range(0, 60, 2)]), path, "id")
        assert rows(files.current(spark, path)) == sorted(((i, f"a{i}") for i in range(40)), key=repr)
    assert files.upsert(spark, make([(i, "b") for i in range(0, 60, 2)]), path, "id") == 1
    want = {i: f"a{i}" for i in range(40)} | {i: "b" for i in range(0, 60, 2)}
    assert rows(files.current(spark, path)) == sorted(want.items(), key=repr)
    # one that was opened before, and the earlier version
    assert rows(open_before) == rows(files.current(spark, path, 0)) == sorted(((i, f"a{i}") for i in range(40)), key=repr)
    # one key touches one bucket
    assert files.upsert(spark, make([(7, "c")]), path, "id") == 2
    assert {r.number: r.touched for r in files.history(spark, path).collect()}[2] == 1
    files.vacuum(spark, path, str(tmp_path / "u"))
    assert rows(files.current(spark, str(tmp_path / "u"))) == sorted((want | {7: "c"}).items(), key=repr) and files.upsert(spark, make([(8, "d")]), str(tmp_path / "u"), "id") == 1
    assert rows(files.current(spark, str(tmp_path / "u"))) == sorted((want | {7: "c", 8: "d"}).items(), key=repr)


def test_null_keys_new_columns_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    files.upsert(spark, spark.createDataFrame([], "id long, v string"), path, "id", buckets=2)
    assert rows(files.current(spark, path)) == [] and files.current(spark, path).columns == ["id", "v"]
    files.upsert(spark, spark.createDataFrame([(None, "x"), (1, "y"), (1, "z")], "id long, v string"), path, "id")
    files.upsert(spark, spark.createDataFrame([(None, 3)], "id long, n long"), path, "id")
    assert rows(files.current(spark, path)) == sorted([(None, None, 3), (1, "z", None)], key=repr)
    assert files.upsert(spark, spark.createDataFrame([], "id long"), path, "id") == 2 and files.current(spark, path).count() == 2
