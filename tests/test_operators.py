"""The reference operators on small planted cases; the queries themselves are compared with SQL by the driver."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from fiscalens.functions import normalize as N
from fiscalens.operators import detectors as D
from fiscalens.operators import graph as G
from fiscalens.operators import quality as Q
from fiscalens.operators import text as T
from fiscalens.sources import files
from fiscalens.streaming import events as E

from oracles import compared_name

DAY = datetime.date


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entry_names_match():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(isinstance(x, str) for x in sql.values()) and all(map(callable, queries.values()))


def test_haversine_and_fences(spark):
    assert value(spark, F.round(D.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), 3)) == 111.195
    c = spark.createDataFrame([(f"{i}", "d", DAY(2020, 1, 1), DAY(2020, 1, 1) + datetime.timedelta(10 if i < 14 else 400)) for i in range(20)], "id string, doc string, validity_start date, validity_end date")
    few = c.where("id < 14 or id = 19")
    assert [r.id for r in D.duration_outliers(few).where("outlier").collect()] == ["19"]
    with pytest.raises(ValueError, match="no such method"):
        D.duration_outliers(c, "other")


def test_sanction_in_force(spark):
    c = spark.createDataFrame([("1", "A", DAY(2020, 1, 1)), ("2", "A", DAY(2021, 1, 1)), ("3", "B", DAY(2020, 1, 1)), ("4", None, DAY(2020, 1, 1))], "id string, doc string, signature_date date")
    s = spark.createDataFrame([("s1", "ceis", "A", None, "n", DAY(2020, 1, 1), DAY(2020, 6, 1)), ("s2", "cnep", "B", "", "n", None, None)], "id string, list_name string, cnpj string, cpf string, sanctioned_name string, start_date date, end_date date")
    assert [(r.doc, r.contracts) for r in D.sanctioned_suppliers(c, s).collect()] == [("A", 1)]


def test_concentration_leaves_out_null_suppliers(spark):
    c = spark.createDataFrame([("b", "x", 50.0), ("b", "y", 50.0), ("b", None, 900.0), ("e", None, 1.0)], "siafi string, doc string, amount double")
    assert {r.siafi: r.hhi for r in D.hhi(c).collect()} == {"b": 0.5, "e": 0.0}


def test_blocking_loses_no_pair(spark):
    e = spark.createDataFrame([(b, s, 3) for b, g in {"1": "xyz", "2": "xy", "3": "yz", "4": "w"}.items() for s in g], "buyer string, supplier string, wins long")
    assert {(r.s1, r.s2, r.buyer_count) for r in D.collusion_pairs(e).collect()} == {("x", "y", 2), ("y", "z", 2)}
    with pytest.raises(ValueError, match="projected"):
        D.collusion_pairs(e, most_pairs=1)


def test_cleaning(spark):
    assert value(spark, N.decimal_br(F.lit("1.234,56")).cast("double")) == 1234.56 and value(spark, N.decimal_br(F.lit("x"))) is None
    assert value(spark, N.date_of(F.lit("31/01/2020"))) == DAY(2020, 1, 31) and value(spark, N.date_of(F.lit("00000000"))) is None
    assert value(spark, N.quantity(F.lit("250m"))) == 0.25 and value(spark, N.quantity(F.lit("2Ki"))) == 2048
    assert value(spark, N.control_number(F.lit("12345678000190-1-000007/2024"))[2]) == 7
    assert value(spark, N.key_of(F.lit("__a b/c.-"))) == "a_b_c"
    assert compared_name("João  da Sílva") == "DA JOAO SILVA"
    assert value(spark, T.documents_match(F.lit("***435151**"), F.lit("12343515100"))) and not value(spark, T.documents_match(F.lit(""), F.lit("1")))


def test_people_and_segments(spark):
    p = spark.createDataFrame([(1, "Ana Maria Souza", "***435151**", "3"), (2, "SOUZA, Ana Maria", "12343515100", "3"), (3, "Outra Pessoa", None, "3")], "id long, name string, document string, age_range string")
    assert [(r.id_a, r.id_b) for r in T.resolve_people(p).collect()] == [(1, 2)]
    t = spark.createDataFrame([(1, "before\nEDITAL 1\nline  \nAVISO DE LICITACAO\nx")], "id long, text string")
    assert [r.segment for r in T.segments(t, "id", "text").orderBy("unit").collect()] == ["EDITAL 1\nline", "AVISO DE LICITACAO\nx"]


def test_editions_of_a_notice_are_no_clones(spark):
    texts = ["Processo 12345.12345678/2020-11 a", "x 12345 . 12345678 / 2020 - 11", "PROCESSO Nº: 123.456/20 b", "processo n. 12-3", "no number", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.n for r in df.select("i", T.process_number(F.col("t")).alias("n")).collect()}
    assert found == {0: "1234512345678202011", 1: "1234512345678202011", 2: "12345620", 3: None, 4: None, 5: None}
    day = lambda k: datetime.date(2020, 1, k)
    rows = [(i, "t", day(i + 1), (t or "none") + " word" * 60, [1.0, 0.0]) for i, t in enumerate(texts[:3] + texts[4:5])]
    pairs = {(r.doc_id, r.old_id) for r in T.notice_clones(spark.createDataFrame(rows, "doc_id int, territory_id string, date date, text string, vector array<double>")).collect()}
    assert pairs == {(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}


def test_near_names_lose_no_pair(spark):
    rng = random.Random(5)
    names = {compared_name("".join(rng.choice("AB ") for _ in range(rng.randint(1, 30)))) for _ in range(150)}
    names |= {n[:i] + rng.choice(["", "A", "X"]) + n[i + 1 :] for n in sorted(names) for i in [rng.randrange(len(n) + 1)]}
    for threshold in (0.95, 0.8):
        left = spark.createDataFrame([(n,) for n in sorted(names)], "a string")
        found = {(r.a, r.b) for r in T.near_names(left, left, threshold).collect()}
        assert found == {(x, y) for x in names for y in names if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= threshold}


def test_fuzzy_screening(spark):
    c = spark.createDataFrame(
        [("1", "12343515100", "Ana Maria de Souza", DAY(2020, 1, 1)), ("2", "99999999999", "Ana Maria de Souza", DAY(2020, 1, 1)), ("3", None, "Obras Pernambuco Ltda", DAY(2020, 1, 1)), ("4", None, "Obras Pernambuco Ltda", DAY(2030, 1, 1)), ("5", None, None, DAY(2020, 1, 1))],
        "id string, doc string, legal_name string, signature_date date")
    s = spark.createDataFrame(
        [("s1", "ceis", "SOUZA, Ana Maria de", "***435151**", DAY(2019, 1, 1), DAY(2021, 1, 1)), ("s2", "cnep", "Obras Pernambuca Ltda", None, DAY(2019, 1, 1), DAY(2021, 1, 1)), ("s3", "cnep", "Obras Pernambuco Ltda", None, None, None), ("s4", "ceaf", None, "12343515100", DAY(2019, 1, 1), None)],
        "id string, list_name string, sanctioned_name string, document string, start_date date, end_date date")
    assert {(r.entity, r.list_name, r.score, r.contracts) for r in T.fuzzy_screening(c, s).collect()} == {("12343515100", "ceis", 1.0, 1), ("LTDA OBRAS PERNAMBUCO", "cnep", 0.9524, 1)}
    assert T.fuzzy_screening(c, s.limit(0)).count() == 0


def test_paths_are_simple_and_reviews_follow_the_table(spark):
    e = spark.createDataFrame([("a", "b", "ownership"), ("b", "a", "ownership"), ("b", "c", "ownership")], "src string, dst string, kind string")
    assert {r.path for r in G.trace_ownership(e, spark.createDataFrame([("a",)], "root string")).collect()} == {"a>b", "a>b>c"}
    q = spark.createDataFrame([("k", "pending", []), ("m", "published", [])], "key string, status string, history array<string>")
    asked = spark.createDataFrame([("k", "confirmed", "me", ""), ("m", "rejected", "me", "why")], "key string, to string, reviewer string, reason string")
    assert {r.key: (r.status, len(r.history)) for r in G.transition(q, asked).collect()} == {"k": ("confirmed", 1), "m": ("published", 0)}


def test_null_violates_a_rule(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "amount double")
    rules = [Q.Rule("positive", ("amount",), "amount > 0"), Q.Rule("absent", ("other",), "other > 0")]
    assert [(r.rule, r.violations, r.sample) for r in Q.check_rules(df, rules).collect()] == [("positive", 2, ["-1.0", "NULL"])]


def test_sinks(spark, tmp_path):
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, dt string"), f"{tmp_path}/p", "dt")
    files.replace_partitions(spark.createDataFrame([(3, "b")], "v int, dt string"), f"{tmp_path}/p", "dt")
    assert {r.v for r in spark.read.parquet(f"{tmp_path}/p").collect()} == {1, 3}


def test_stream_counts_by_hour(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i % 3), "view", 1.0) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = E.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {r.events for r in spark.table("hours").collect()} == {3}
