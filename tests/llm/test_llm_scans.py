"""Periodic runs, ball k-means and licence scans against brute force, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalens.llm import ballkmeans, langid, licences, periodic
from fiscalens.llm.queries import oracle_sql

DOCS = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_runs(words, shortest=12):
    """Every lag, pair by pair; a stretch counts at its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(shortest, 2 * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng, n, kinds):
    x = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 4 else 0):
        a, b = sorted(rng.sample(range(n), 2))
        p = rng.randint(1, max(1, (b - a) // 2))
        for i in range(a, b):
            x[i] = x[a + (i - a) % p]
    return x


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(120):
        x = repetitive(rng, rng.choice([0, 1, 11, 12, 13, 40, 130, 260]), rng.choice([1, 2, 3, 6, 50]))
        ids = np.unique(np.array(x, np.int64), return_inverse=True)[1]
        assert periodic.runs(ids) == plain_runs(x)


def test_heavy_and_light_words_give_all_matches(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(periodic, "PAIRS", 1000)
    for n, kinds in ((3000, 5), (3000, 400), (500, 1), (7, 7)):
        ids = np.unique(np.minimum(rng.zipf(1.4, n), kinds), return_inverse=True)[1]
        assert periodic.lag_matches(ids, n // 2)[1:].tolist() == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 2 + 1)]


def test_one_word_many_times_is_one_run():
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    x = np.arange(200_000) % 1000
    assert periodic.runs(x) == [(0, 200_000, 1000)]


def periodic_docs():
    rng = random.Random(9)
    vocabulary = ["a", "b", "é", "日本", "x.", " y", "z "]
    out = [(None, "w " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b " * 6), (5, "a b " * 6), (6, "x" * 50_000 + " y" * 40)]
    for i in range(10, 210):
        words = [rng.choice(vocabulary) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(rng.choice([1, 2, 14, 60, 200]))]
        out.append((i, rng.choice([" ", "\n", "  ", "\x0b"]).join(words)))
    return out


def test_op11_is_the_plain_scan(spark):
    docs = periodic_docs()
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "_best", "length")})
    want, planted = [], 0
    for doc_id, text in docs:
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = plain_runs(words)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
        want.append((doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert planted > 10 and sum(w[1] for w in want) > 10
    assert sorted([tuple(r[c] for c in names) for r in rows(periodic.op11(df.repartition(3)))], key=str) == sorted(want, key=str)
    assert periodic.op11(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_and_collapsed_text(spark):
    text = "start " + "la li " * 9 + "end"
    (r,) = rows(periodic.periodic_runs(spark.createDataFrame([(7, text)], DOCS)))
    assert [tuple(x) for x in r["runs"]] == [(1, 18, 2)] and r["collapsed"] == "start la li end" and r["n_words"] == 20


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=700, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, 64))
    x = centers[rng.integers(0, 9, n)] + rng.normal(scale=rng.choice([0.02, 0.4], n)[:, None], size=(n, 64))
    return [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]


def plain_kmeans(kept, k=16, rounds=3):
    x = [[math.floor(64 * float(c)) for c in v] for _, v in kept]
    first = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), np.array(x[i], "<i4").tobytes()))[:k]
    centers = [x[i] for i in first]
    for turn in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for v in x]
        if turn < rounds:
            for j in range(len(centers)):
                own = [v for v, (_, q) in zip(x, at, strict=True) if q == j]
                if own:
                    centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return at, centers


def test_op12_is_plain_kmeans(spark):
    some = vectors(260)
    nan, inf = [0.0] * 63 + [float("nan")], [float("-inf")] + [1.0] * 63
    odd = [(900, None, 0), (901, [1.0] * 63, 0), (902, [1.0] * 65, 0), (903, nan, 0), (904, inf, 0), (905, [None] + [1.0] * 63, 0), (906, [], 0), (907, [3e38] * 64, 0)]
    ties = [(5, some[5][1], 0), (5, some[6][1], 0), (None, [0.0] * 64, 0), (None, [0.0] * 64, 0)]
    data = some + odd + ties
    df = spark.createDataFrame(data, VECTORS).withColumns({c: F.lit(1) for c in ("raw", "cluster", "distance", "v", "n")})
    kept = [(i, np.array(v, np.float32)) for i, v, _ in some + ties]
    at, centers = plain_kmeans(kept)
    total = sum(d for d, _ in at)
    want = [(i, k, d, sum(e for e, q in at if q == k), total, hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, at, strict=True)]
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted([tuple(r[c] for c in names) for r in rows(ballkmeans.op12(df.repartition(4)))], key=str) == sorted(want, key=str)
    assert ballkmeans.op12(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame(some[:3], VECTORS)
    assert sorted(r["distance"] for r in rows(ballkmeans.op12(few))) == [0, 0, 0]


def test_op12_sql(spark, tmp_path):
    df = spark.createDataFrame(vectors(400), VECTORS)
    df.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op12_ball_kmeans']})").fetchall()) == sorted(tuple(r[c] for c in names) for r in rows(ballkmeans.op12(df)))


def test_balls_spare_comparisons_and_move_as_all_would(spark):
    state, centers = ballkmeans.ball_kmeans(spark.createDataFrame(vectors(), VECTORS), rounds=4)
    found = rows(state)
    assert sum(r["compared"] for r in found) < 0.5 * len(found) * len(centers)
    x = np.array([np.frombuffer(bytes(r["raw"]), "<i4") for r in found], np.int64)
    d = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert [r["cluster"] for r in found] == d.argmin(1).tolist() and [r["distance"] for r in found] == d.min(1).tolist()


def test_reassigned_takes_the_smaller_number_on_ties():
    centers = np.array([[0, 0], [4, 0], [2, 0]])
    gap = lambda k: ((centers - centers[k]) ** 2).sum(1)
    near = [np.array([j for j in np.lexsort((np.arange(3), gap(k))) if j != k]) for k in range(3)]
    balls = ballkmeans.Balls(centers, near, [gap(k)[near[k]] for k in range(3)])
    at, d, _ = ballkmeans.reassigned(np.array([[1, 0], [3, 0], [1, 0], [4, 0]]), np.array([2, 2, 1, 1], np.int32), balls)
    assert at.tolist() == [0, 1, 0, 1] and d.tolist() == [1, 1, 1, 0]


@pytest.mark.parametrize(
    ("text", "post", "value"),
    [
        ("MIT", "mit", 0.2),
        ("MIT OR GPL-2.0-only", "mit gpl-2.0-only or", 0.2),
        ("MIT AND GPL-2.0-only", "mit gpl-2.0-only and", 0.8),
        ("mit or apache-2.0 and gpl-3.0+", "mit apache-2.0 gpl-3.0+ and or", 0.2),
        ("(MIT OR Apache-2.0) AND AGPL-3.0", "mit apache-2.0 or agpl-3.0 and", 0.9),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "gpl-2.0 classpath-exception-2.0 with mit and", 0.5),
        ("MIT AND ((BSD OR ISC) AND GPL-2.0)", "mit bsd isc or gpl-2.0 and and", 0.8),
        ("MIT and contributors", "mit", 0.2),
        ("(MIT OR (Apache-2.0", "mit apache-2.0 or", 0.2),
        ("MIT) OR GPL-2.0", "mit", 0.2),
        ("MIT WITH OR GPL-2.0", "mit", 0.2),
        ("(MIT) WITH Classpath-exception-2.0", "mit", 0.2),
        ("LicenseRef-own OR MIT", "licenseref-own mit or", 0.2),
        ("nothing known", "", None),
        ("()", "", None),
    ],
)
def test_expressions(text, post, value):
    found = licences.postfix(licences.tokens(text.encode(), 0))
    assert " ".join(found) == post and licences.evaluated(found) == value


def test_deep_parentheses():
    found = licences.postfix(licences.tokens(b"(" * 50_000 + b"MIT" + b" OR GPL-2.0)" * 50_000, 0))
    assert licences.evaluated(found) == 0.2 and len(found) == 100_001


LICENCE_TEXTS = [
    None, "", "   ", "nothing of the kind", "cc by", "CC-BY", "c c by", "ccby", "cc by", "Cc.\tBY!cc by", "cc by cc by cc", "CC BY-NC-SA 4.0",
    "GNU General Public License, version 3.", "GNU Lesser General Public License", "the GNU Affero\nGeneral   Public License", "general public licenses", "All Rights Reserved.", "é all rights reservedé all rights reserved",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nAll rights reserved.", "SPDX-License-Identifier: Strange-1.0", "SPDX-License-Identifier", "license: MIT", '{"license": "BSD-3-Clause"}', "license: see file", "a license of mine",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Kelvin K cc by", "cc by " * 3000,
]


def test_op13_is_the_plain_scan(spark):
    docs = [(i, t) for i, t in enumerate(LICENCE_TEXTS)] + [(None, "cc by"), (4, "cc by")]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("spans", "labels", "n_words", "expressions")})
    found = {(r["doc_id"], r["n_words"]): r for r in rows(licences.op13(df.repartition(3)))}
    for doc_id, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = found[doc_id, len(words)]
        starts = [i for i, _ in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None)), text
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})), text
        assert {x for _, x in places} <= set(r["labels"].split(",")) and r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and 0 <= r["score"] <= 1
    by = {i: r for (i, _), r in found.items()}
    at = {t: by[i] for i, t in enumerate(LICENCE_TEXTS)}
    assert len(found) == len(docs) - 1 and licences.op13(df).count() == len(docs)
    assert at["nothing of the kind"]["labels"] == "" and at["nothing of the kind"]["score"] == 0
    assert at["CC BY-NC-SA 4.0"]["labels"] == "cc-by,cc-by-nc-sa" and at["CC BY-NC-SA 4.0"]["score"] == 0.9
    assert at["GNU Lesser General Public License"]["labels"] == "gpl,lgpl" and at["GNU Lesser General Public License"]["score"] == 0.5
    assert at["# SPDX-License-Identifier: (MIT OR Apache-2.0)\nAll rights reserved."]["labels"] == "apache-2.0,mit,reserved"
    assert at["# SPDX-License-Identifier: (MIT OR Apache-2.0)\nAll rights reserved."]["score"] == 0.2
    assert at["SPDX-License-Identifier: Strange-1.0"]["labels"] == "unknown" and at["SPDX-License-Identifier"]["labels"] == ""
    assert at["license: MIT"]["labels"] == "mit" and at['{"license": "BSD-3-Clause"}']["labels"] == "bsd-3-clause"
    assert at["license: see file"]["labels"] == "" and at["a license of mine"]["labels"] == "" and at["All Rights Reserved."]["score"] == 1
    assert licences.op13(spark.createDataFrame([], DOCS)).count() == 0


def test_phrases_by_the_automaton_are_those_of_a_plain_search():
    rng = random.Random(4)
    phrases = {p: x for p, x in licences.BASE.items()} | {p: x for x, ps in licences.NOTICES.items() for p in ps}
    vocabulary = sorted({w for p in phrases for w in p.split()} | {"filler"})
    for _ in range(300):
        words = [w for _ in range(8) for w in (rng.choice(sorted(phrases)).split() if rng.random() < 0.5 else [rng.choice(vocabulary)])]
        n, spans, _ = licences.scanned("--".join(words).encode())
        places = [(i, len(p.split()), x, "base" if p in licences.BASE else "notice") for p, x in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        outer = [s for s in places if s[3] == "base" or not any(t != s and t[0] <= s[0] and s[0] + s[1] <= t[0] + t[1] and t[1] > s[1] for t in places)]
        assert n == len(words) and sorted(spans) == sorted(outer)


LABELLED = "doc_id long, text string, lang string, source string, n_chars long"


def test_spellings_of_a_label_are_one_language(spark):
    texts = {"en": "the thing and with", "pt": "que a casa da gente", "de": "der und schei keit"}
    spelled = {"en": ["EN", "en", " en "], "pt": ["pt-BR", "pt_br", "PT-br", "pt-BR"], "de": ["de"]}
    data = [(i, texts[k], spelled[k][i % len(spelled[k])], "h", 1) for k in texts for i in range(60)]
    df = spark.createDataFrame(data, LABELLED)
    names, _ = langid.fit_text_model(df)
    assert names == ["de", "en", "pt-BR"]
    report = {r.tag: (r.name, r.rows, r.place) for r in langid.label_report(df).collect()}
    assert report == {"de": ("de", 60, 0), "en": ("en", 60, 1), "pt-br": ("pt-BR", 60, 2)}
    out = rows(langid.op8(df))
    assert {r["lang"] for r in out} == {"de", "en", "pt-BR"} and all(r["kept"] for r in out)


def test_thousands_of_labels_plan_in_seconds(spark):
    import time

    data = [(i, "the thing and with", "en", "h", 1) for i in range(300)] + [(1000 + i, "dirty value", f"x{i:04}", "h", 1) for i in range(5000)]
    df = spark.createDataFrame(data, LABELLED).repartition(4)
    names, table = langid.fit_text_model(df, most_languages=50)
    assert "en" in names and len(names) == 50
    report = langid.label_report(df, most_languages=50)
    assert report.where("place is null").agg(F.sum("rows")).first()[0] == 5000 - 49
    many = [*names, *(f"y{i:04}" for i in range(4950))]
    wide = np.concatenate([table, np.full((4950, langid.GRAMS), -20, np.float32)])
    one = df.where("doc_id < 5").select("doc_id", "text")
    none = F.lit(None).cast("string")
    bands = (np.full((5000, langid.CLASSES), -100.0), np.ones(5000))
    began = time.time()
    out = langid.identify(one, many, wide, F.col("text"), none, none, none, bands=bands)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000
    found = rows(out)
    assert time.time() - began < 60 and {r["lang"] for r in found} == {"en"}


def test_bands_by_hand(spark):
    rng = random.Random(12)
    stems = {"en": ["the", "and", "thing"], "de": ["der", "und", "keit"]}
    data = [(i, " ".join(rng.choice(stems[k]) for _ in range(rng.choice([2, 9, 40]))), k, "h", 1) for i in range(300) for k in [rng.choice(["en", "de"])]] + [(900, "", "en", "h", 1), (901, None, "de", "h", 1)]
    df = spark.createDataFrame(data, LABELLED)
    names, table = langid.fit_text_model(df)
    least, variance = langid.text_bands(df, names, table)
    wordy = lambda b: b in b"abcdefghijklmnopqrstuvwxyz \n" or b >= 0x80
    groups = {}
    for _, text, lang, *_ in data:
        raw = (text or "").encode()
        h, _ = langid.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        keep = np.array([all(wordy(b) for b in raw[i : i + 3]) for i in range(len(raw) - 2)], bool)
        if not keep.any() or int(table[:, h].sum(1).argmax()) != names.index(lang):
            continue
        k = names.index(lang)
        groups.setdefault((k, int(np.log2(keep.sum()))), []).append(float(np.float32(table[k][h][keep].astype(float).mean())))
    for k in range(2):
        own = [x for (q, _), v in groups.items() if q == k for x in v]
        for c in range(langid.CLASSES):
            v = sorted(groups.get((k, c), []))
            v = v if len(v) >= langid.CLASS_ROWS else sorted(own)
            low, mid = (v[math.ceil(p * len(v)) - 1] for p in (0.05, 0.5))
            assert least[k, c] == pytest.approx(mid - min(max(3 * (mid - low), langid.LEAST_WIDTH), langid.MOST_WIDTH), abs=1e-5)
    p = np.exp(table.astype(float))
    p /= p.sum(1, keepdims=True)
    assert np.allclose(variance, (p * table**2).sum(1) - (p * table).sum(1) ** 2)


@pytest.mark.parametrize("few", [100_000, 0])
def test_cut_payloads_are_found_in_many_byte_ranges(spark, monkeypatch, few):
    import functools

    from fiscalens.llm import warc
    from fiscalens.llm.shared import new_folder

    rng = random.Random(2)
    pages = []
    for i in range(60):
        body = "".join(rng.choice("abc<>\n") for _ in range(rng.randint(100, 3000)))
        for _ in range(rng.randrange(4)):  # magic lines inside payloads
            at = rng.randrange(len(body))
            body = body[:at] + warc.MAGIC + body[at:] + "é" * rng.randrange(3)
        pages.append((i, f"http://h/{i}", body))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc, "_mend", functools.partial(warc._mend, broadcast_rows=few))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    if not few:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = new_folder(spark, "warc-test")
        warc.write_archives(warc.to_records(warc.mark_revisits(df, "page_id", "html"), "page_id", "url", "html"), path)
        found = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {f"<urn:page:{i}>": (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in pages}
    assert found == want
