"""Encoders and exact cosine joins against brute force."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalens.operators import cosine_join as J
from fiscalens.operators import encoder as E
from fiscalens.operators import text as T

DAY = datetime.date


def corpus(rng, n=160, kinds=500):
    vocabulary = [f"palavra{i}" for i in range(kinds)]
    base = [[rng.choice(vocabulary) if rng.random() < 0.8 else "de" for _ in range(rng.choice([5, 40, 90]))] for _ in range(n)]
    for _ in range(n // 2):
        x = rng.choice(base)[:]
        for _ in range(rng.randrange(1, 4)):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        base.append(x)
    return base


def plain_tfidf(texts):
    tf = [Counter(t) for t in texts]
    df = Counter(w for t in tf for w in t)
    rows = [{w: (1 + np.log(n)) * (1 + np.log((1 + len(texts)) / (1 + df[w]))) for w, n in t.items()} for t in tf]
    return [{w: x / np.sqrt(sum(y * y for y in r.values())) for w, x in r.items()} for r in rows]


@pytest.mark.parametrize(("cell", "threshold"), [(512, 0.85), (3, 0.85), (2, 0.5)])
def test_sparse_pairs_are_all_pairs(spark, monkeypatch, cell, threshold):
    rng = random.Random(cell)
    texts = corpus(rng)
    group = [rng.choice("abb") for _ in texts]
    monkeypatch.setattr(J, "CELL", cell)
    docs = spark.createDataFrame([(i, g, " ".join(t)) for i, (g, t) in enumerate(zip(group, texts, strict=True))], "id long, g string, text string")
    v = docs.select("id", "g").join(E.tfidf(docs, "id", "text"), "id").cache()
    found = {(r.a, r.b): r.similarity for r in J.sparse_pairs(v, threshold, ["g"]).collect()}
    plain = plain_tfidf(texts)
    want = {(i, j): s for i in range(len(texts)) for j in range(i + 1, len(texts)) if group[i] == group[j] and (s := sum(x * plain[j].get(w, 0) for w, x in plain[i].items())) > threshold}
    assert len(want) > 20 and found.keys() == want.keys() and all(abs(found[k] - min(1, want[k])) < 1e-9 for k in want)
    met = J.candidates(v, threshold, ["g"]).collect()
    assert len(met) == len(set(met)) and len(met) < len(texts) ** 2 / 8


def notices(rng, n=120):
    texts = corpus(rng, n)
    number = lambda i: f"Processo nº 123456{i % 3} " if i % 5 == 0 else ""
    return [(i, rng.choice(["1", "1", "2", "", None]), DAY(2020, 1, 1) + datetime.timedelta(rng.randrange(700)) if i % 17 else None, number(i) + " ".join(t)) for i, t in enumerate(texts)]


def plain_clones(rows, similarity, threshold=0.85):
    import re

    number = lambda t: (m := re.search(r"Processo nº (\d+)", t)) and m[1]
    ok = [r for r in rows if r[1] and r[2] and len(r[3].strip()) >= 200]
    return {(a[0], b[0]) for a in ok for b in ok if a[1] == b[1] and 0 < (a[2] - b[2]).days <= 365 and not (number(a[3]) and number(a[3]) == number(b[3])) and similarity(a, b) > threshold}


@pytest.mark.parametrize("cell", [2048, 4])
def test_dense_clones_are_all_pairs(spark, monkeypatch, cell):
    rows = notices(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, territory_id string, date date, text string")
    import functools

    monkeypatch.setattr(T, "dense_pairs", functools.partial(J.dense_pairs, cell=cell))

    def counts(t):
        out = np.zeros(64)
        import hashlib

        for w in t.lower().split(" "):
            out[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
        return out / np.linalg.norm(out)

    v = {r[0]: counts(r[3]) for r in rows}
    want = plain_clones(rows, lambda a, b: v[a[0]] @ v[b[0]])
    found = [(r.doc_id, r.old_id) for r in T.notice_clones(df, encode=T.hashed_words).collect()]
    assert len(want) > 10 and len(found) == len(want) and set(found) == want
    last = max(r[2] for r in rows if r[2])
    assert {(r.doc_id, r.old_id) for r in T.notice_clones(df, encode=T.hashed_words, reference_date=F.lit(last)).collect()} == {(a, b) for a, b in want if rows[a][2] == last}


def test_counts_whose_cosine_is_the_threshold_are_not_above_it(spark):
    a, b = [0.0, 3.0, 4.0], [1.0, 4.0, 8.0]  # of norms 5 and 9
    scaled = lambda x, k: [k * y for y in x]
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    of = lambda sign: spark.createDataFrame([(i, "g", scaled(a if sign else b, float(i))) for i in range(1, 60)], "id long, g string, vector array<double>")
    every = lambda x, y, i, j: np.ones(len(i), bool)
    exact = dot(a, b) / 45
    assert J.dense_pairs(of(True), of(False), ["g"], "long", every, exact).count() == 0
    assert J.dense_pairs(of(True), of(False), ["g"], "long", every, np.nextafter(exact, 0)).count() == 59 * 59
    tiny = spark.createDataFrame([(1, "g", [1e-170, 0.0]), (2, "g", [0.0, 0.0])], "id long, g string, vector array<double>")
    assert [tuple(r) for r in J.dense_pairs(tiny, tiny, ["g"], "long", every, 0.5).collect()] == [(1, 1, 1.0)]


def test_sparse_clones_are_all_pairs_and_windows_are_counted(spark):
    rows = notices(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, territory_id string, date date, text string")
    ok = [r for r in rows if r[1] and r[2] and len(r[3].strip()) >= 200]
    plain = dict(zip([r[0] for r in ok], plain_tfidf([[w for w in __import__("re").split(r"[^a-z0-9º]+", r[3].lower()) if w] for r in ok]), strict=True))
    want = plain_clones(rows, lambda a, b: sum(x * plain[b[0]].get(w, 0) for w, x in plain[a[0]].items()))
    assert len(want) > 5 and {(r.doc_id, r.old_id) for r in T.sparse_clones(df).collect()} == want
    pairs = {r.territory_id: r.pairs for r in T.window_pairs(df).collect()}
    assert pairs == {t: sum(1 for a in ok for b in ok if a[1] == b[1] == t and 0 < (a[2] - b[2]).days <= 365) for t in ("1", "2")}
    assert T.sparse_clones(df.limit(0)).count() == 0


def test_an_entry_of_the_index_is_bounded_and_vectors_pack(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", *[f"r{i // 2}x{k}"] * 40]) for k in range(300)) for i in range(40)] + [" ".join(f"only{k} only{k}" for k in range(50)), "\t", None, " ".join(["a"] * 700 + ["b"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("g", F.lit(1))
    sizes = []

    def kept(df, name):
        out = written(df, name)
        if name == "prefix-index":
            sizes.append(out.agg(F.max(F.size("_before")), F.count("id")).first())
        return out

    written = J.written
    monkeypatch.setattr(J, "written", kept)
    words = E.document_frequencies(docs, "text")
    v = E.weighted(docs, "id", "text", words).cache()
    pairs = {(r.a, r.b) for r in J.candidates(v, 0.85, ["g"]).collect()}
    assert sizes[0][0] <= 2 and sizes[0][1] < 40 * 200 and {(i, i + 1) for i in range(0, 40, 2)} <= pairs
    flat = lambda df: {(r.id, x.f): (x.df, round(x.w, 12)) for r in df.collect() for x in r.terms}
    joined = E.weighted(docs, "id", "text", words._replace(sent=None))
    assert flat(v) == flat(joined) and [x.df for x in v.first().terms] == sorted(x.df for x in v.first().terms)
    all_pairs = spark.createDataFrame([(i, j) for i in range(43) for j in range(i)], "a long, b long")
    dots = lambda df, how: {(r.a, r.b): round(r.similarity, 12) for r in J.scored(all_pairs, df, 0.01, unpack=how).collect()}
    assert dots(E.packed(docs, "id", "text", words), E.unpacked(words)) == dots(joined, None) != {}
    monkeypatch.setattr(E, "SENT", 0)
    assert E.document_frequencies(docs, "text").sent is None


def test_fitted_axes_are_those_of_the_whole_matrix(spark):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) for _ in range(60)) for i in range(300)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    model = E.fit(df, dims=6, features=1 << 10, extra=10, passes=3)
    a = np.zeros((len(texts), 1 << 10))
    for i, t in enumerate(texts):
        f, n = E.counted(t, 1 << 10)
        a[i, f] = E.weights(n, model.idf[f])
    s, vt = np.linalg.svd(a, full_matrices=False)[1:]
    assert np.allclose(model.axes.T @ model.axes, np.diag(1 / s[:6] ** 2), atol=1e-5)
    assert np.allclose(np.abs(np.diag(vt[:6] @ (model.axes * s[:6]))), 1, atol=1e-3)
    vectors = [np.array(r.v) for r in df.select("text", E.encode_with(spark, model)(F.col("text")).alias("v")).collect() if r.text]
    label = [r.text.split("w")[0] for r in df.collect() if r.text]
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    cosine, same = unit @ unit.T, np.array(label)[:, None] == np.array(label)
    assert cosine[same].min() > 0.8 and cosine[~same].max() < 0.3
    empty = df.where("text is null or text = ''").select(E.encode_with(spark, model)(F.col("text")).alias("v")).collect()
    assert len(empty) == 2 and all(set(r.v) == {0.0} for r in empty)


def test_a_decomposition_of_many_parts_is_that_of_one(spark, monkeypatch):
    df = spark.createDataFrame([(f"a{i % 7} b{i % 5} c{i % 3}",) for i in range(90)], "text string")
    monkeypatch.setattr(E, "FAN_IN", 2)
    monkeypatch.setattr(E, "ROWS", 37)
    x, y = (E.fit(df.repartition(n), dims=4, features=128, extra=4) for n in (1, 7))
    assert np.allclose(x.idf, y.idf) and np.allclose(np.abs(x.axes), np.abs(y.axes), atol=1e-4)
    none = E.fit(df.limit(0), dims=4, features=128, extra=4)
    assert not none.axes.any()


def test_rates(spark):
    found = spark.createDataFrame([(1, 2), (3, 4)], "doc_id long, old_id long")
    planted = spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")
    windows = spark.createDataFrame([("x", 4, 8), ("y", 2, 4)], "territory_id string, notices long, pairs long")
    assert tuple(T.clone_rates(found, planted, windows).first()) == (2, 12, 0.5, 0.1)
    assert tuple(T.clone_rates(found.limit(0), planted.limit(0), windows.limit(0)).first()) == (0, 0, 1.0, 0.0)


def test_names_meet_in_cells_and_long_names_count_right(spark, monkeypatch):
    import difflib

    from fiscalens.operators import name_join as X

    rng = random.Random(6)
    names = sorted({"".join(rng.choice("AB C") for _ in range(rng.choice([1, 7, 8, 30, 31]))).strip() or "A" for _ in range(120)} | {"A" * n for n in (127, 128, 129, 260, 300, 301)} | {"AB " * 90})
    df = spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "name string")
    want = {(x, y) for x in names for y in names if difflib.SequenceMatcher(None, x, y).ratio() >= 0.9}
    for cells in ((2048, 4096, 256), (5, 3, 2)):
        for name, n in zip(("CELL_A", "CELL_B", "AT_ONCE"), cells, strict=True):
            monkeypatch.setattr(X, name, n)
        found = [(r.a, r.b) for r in X.near_names(df, df, 0.9).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    i, j = X.survivors(names, names, 0.9)
    assert want <= {(names[x], names[y]) for x, y in zip(i, j, strict=True)} and len(i) < len(names) ** 2 / 2


def test_the_index_gives_what_a_scan_gives(spark):
    from fiscalens.operators import vector_index as V

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 900)] + rng.normal(scale=0.05, size=(900, 16))
    x[10:14] = x[9]  # ties
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(2000, [0.0] * 16), (2001, None), (2002, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    path = V.build(df, cells=40)
    for query, most in ((x[9].tolist(), 20), (x[500].tolist(), 20), ([0.1] * 16, 40), ((-x[9]).tolist(), 40)):
        for k in (1, 7, 60):
            found = V.search(spark, path, query, k, step=2)
            assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in T.vector_search(df, query, k).collect()]
            assert found.cells <= 40 and found.read <= most
    assert V.search(spark, path, x[500].tolist(), 5, step=2).read <= 12
    empty = V.build(df.limit(0), cells=4)
    assert V.search(spark, empty, x[0].tolist()).rows.count() == 0
