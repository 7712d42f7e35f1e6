"""Normalisers, graphs, notices, reviews, quality, sources and sinks on small planted cases."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalens.functions import normalize as N
from fiscalens.operators import detectors as D
from fiscalens.operators import forest as X
from fiscalens.operators import graph as G
from fiscalens.operators import marts as M
from fiscalens.operators import normalizers as R
from fiscalens.operators import quality as Q
from fiscalens.operators import reviews as V
from fiscalens.operators import text as T
from fiscalens.sources import files

from oracles import compared_name

DAY = datetime.date


def test_names_as_text(spark):
    names = ["João  da Sílva", "O'Brien & Søn", "ÀÉÎõü ç", "", None, "été", "Ｆｕｌｌ １２"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    found = {r.i: (r.a, r.b) for r in df.select("i", N.sorted_words(F.col("n")).alias("a"), N.plain_text(F.col("n")).alias("b")).collect()}
    assert all(found[i][0] == compared_name(n) for i, n in enumerate(names))
    assert found[0][1] == "JOAO DA SILVA"


def test_portal_contract_falls_through_what_is_empty(spark):
    one = {"numeroControlePNCP": "", "orgaoEntidade": {"cnpj": "1"}, "anoCompra": "2024", "sequencialCompra": "", "sequencial": "7", "valorTotalHomologado": "", "valorGlobal": "12,5", "dataAberturaProposta": "x 2024-02-03 y", "modalidadeId": 9, "niFornecedor": "123.456.789-01"}
    df = spark.createDataFrame([(json.dumps(one),)], "v string").select(F.from_json("v", files.CONTRACT_RECORD).alias("r")).select("r.*")
    r = R.contracts_from_pncp(df, "2024-05-01").first()
    assert (r.id, r.modality, r.status, float(r.amount), r.signature_date, r.supplier.cpf, r.supplier.cnpj, r.buyer.government_level) == ("1-2024-7", "inexigibilidade", "published", 12.5, DAY(2024, 2, 3), "12345678901", None, "federal")
    bare = R.contracts_from_pncp(spark.createDataFrame([("a",)], "other string"), "2024-05-01").first()
    assert (bare.id, bare.amount, bare.signature_date, bare.buyer.name) == ("unknown", 0, DAY(2024, 5, 1), "Agency not informed")
    assert R.contracts_from_pncp(files.read(spark, "mock_pncp", "")).first().supplier.cnpj == "12345678000190"
    assert float(R.contracts_from_transparency(files.read(spark, "mock_transparency", "")).first().amount) == 1000


def test_latest_payload_counts_and_unknown_ones_are_null(spark):
    c = spark.createDataFrame([("a", "2024", "s", "d", "pregao"), ("b", "2024", "s", "d", None)], "id string, dt string, siafi string, doc string, modality string")
    item = lambda final, end="2024-03-01": json.dumps([{"numeroControlePNCP": "a", "valorInicialCompra": "10", "valorTotalHomologado": final, "dataAberturaProposta": "2024-01-10", "dataEncerramentoProposta": "2024-01-09T00", "valorInicial": "10", "valorAcumulado": final, "dataVigenciaFim": end}, {"numeroControlePNCP": "zz"}])
    raw = spark.createDataFrame([("2024-01-01", 2, item("11")), ("2024-01-01", 1, item("9")), ("2023-01-01", 5, item("x", "2024-02-01"))], "dt string, ingested_at int, payload_json string")
    flags = {r.id: r for r in M.red_flags(c, raw).collect()}
    assert (flags["a"].f_price_ratio, flags["a"].f_short_window, flags["a"].f_non_competitive, flags["a"].cri) == (1, 1, 0, 0.6667)
    assert not flags["b"].bronze_matched and flags["b"].cri is None
    a = {r.id: r for r in M.amendments(c, raw, raw.where("false")).collect()}["a"]
    assert (a.observations, a.f_value, a.f_term, a.ratio) == (3, 1, 1, 1.1)


def test_terms_fire_on_amendments_alone(spark):
    term = lambda kind="Termo Aditivo", raises=True, value="5", extends=False, days=None: {"tipoTermoContratoNome": kind, "qualificacaoAcrescimoSupressao": raises, "valorAcrescido": value, "qualificacaoVigencia": extends, "prazoAditadoDias": days}
    cases = {"none": None, "empty": [], "raise": [term()], "other": [term(kind="Apostila")], "less": [term(value="-5")], "days": [term(raises=None, extends=True, days=3), term(raises=False, value="x")]}
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in cases.items()], "id string, terms string")
    got = {r.id: (r.f_value_terms, r.f_term_terms, r.terms_count, r.value_increase, r.days_extended) for r in M.term_flags(df).collect()}
    assert got == {"none": (None,) * 5, "empty": (0, 0, 0, 0, 0), "raise": (1, 0, 1, 5, 0), "other": (0, 0, 1, 5, 0), "less": (0, 0, 1, -5, 0), "days": (0, 1, 2, 5, 3)}


def test_company_graph_and_entities(spark):
    companies = spark.createDataFrame([("00000001", "One")], "cnpj_basico string, razao_social string")
    columns = "partner_id string, cnpj_basico string, identificador string, nome string, qualificacao string, data_entrada date, cnpj_cpf_socio string, pais string, representante_legal string, nome_representante string, qualificacao_representante_legal string"
    p = spark.createDataFrame([("p1", "00000001", "2", "Ana", "49", DAY(2020, 1, 1), "***1**", None, None, "Rui", "17"), ("p2", "00000001", "1", "Two SA", "22", None, "00000002000100", None, None, None, None), ("p3", "00000003", "2", "Eva", "8", None, None, None, None, None, None)], columns)
    vertices, edges = G.company_graph(companies, p)
    assert {(r.schema, r.name) for r in vertices.collect()} == {("Company", "One"), ("Company", "Two SA"), ("Person", "Ana"), ("Person", "Rui"), ("Person", "Eva")}
    assert sorted((r.kind, r.source[:9]) for r in edges.where("target = 'companies/00000001'").collect()) == [("directorship", "persons/" + edges.where("role = '17'").first().source[8]), ("directorship", "persons/p"), ("ownership", "companies"), ("ownership", "persons/p")]
    assert [r.kind for r in edges.where("target = 'companies/00000003'").collect()] == ["directorship"]
    out = G.ftm_entities(vertices, edges, spark.createDataFrame([("00000001000155",), ("00000009",)], "root string")).collect()
    assert len(out) == 4 + 4 and {r.root for r in out} == {"00000001000155"}
    assert json.loads(next(r.properties for r in out if r.id == "company-00000001")) == {"name": ["One"], "registrationNumber": ["00000001"]}
    assert json.loads(next(r.properties for r in out if r.schema == "Ownership" and "person" in r.id))["startDate"] == ["2020-01-01"]


def test_headers_are_found_whatever_their_marks(spark):
    text = "preamble\r\nAviso de  Licitação nº 1\nline  \n  édital 2\n\n" + "EDITAL " + "x" * 130 + "\nprocesso 3\x85tail\n "
    out = [r.segment for r in T.segments(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "i int, t string"), "i", "t").orderBy("i", "unit").collect()]
    assert out == ["Aviso de  Licitação nº 1\nline", "édital 2\n\nEDITAL " + "x" * 130, "processo 3\ntail"]


def test_gazettes_give_clones_of_the_latest_day(spark, tmp_path):
    words = " ".join(f"palavra{i}" for i in range(60))
    for name, text in {"1234567-2024-01-10-0123456789ab.txt": f"EDITAL 1\n{words}", "1234567-2024-05-10-0123456789ac.txt": f"EDITAL 2\n{words} fim", "1234567-2022-05-10-0123456789ad.txt": f"EDITAL 3\n{words}", "x.txt": f"EDITAL 4\n{words}", "7654321-2024-05-10-0123456789ae.txt": f"EDITAL 5\n{words}"}.items():
        (tmp_path / name).write_text(text)
    out = T.gazette_clones(files.read(spark, "gazettes", str(tmp_path))).collect()
    assert len(out) == 1 and len(out[0].entity_id) == 64 and out[0].score > 0.95
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2), (2, 3, 0.9), (4, 5, 0.1)], "a int, b int, similarity double")
    assert tuple(T.planted_rates(spark.createDataFrame([(1, 2), (1, 3)], "a int, b int"), pairs, 0.85).first()) == (0.5, 0.5)
    assert tuple(T.planted_rates(pairs.limit(0).select("a", "b"), pairs.limit(0), 0.85).first()) == (1.0, 0.0)


def test_people_meet_in_cells(spark, monkeypatch):
    rng = random.Random(1)
    people = [(i, f"Ana {rng.choice(['Lima', 'Lime', 'Souza', 'Zito'])}", rng.choice([None, "123", "456"]), rng.choice(["1", "2"])) for i in range(40)]
    df = spark.createDataFrame(people, "id long, name string, document string, age_range string")
    whole = sorted(map(tuple, T.resolve_people(df).collect()))
    monkeypatch.setattr(T, "CELL", 5)
    assert whole and sorted(map(tuple, T.resolve_people(df).collect())) == whole
    import difflib

    expected = []
    for i, a in enumerate(people):
        for b in people[i + 1 :]:
            x, y = compared_name(a[1]), compared_name(b[1])
            score = 0.6 * difflib.SequenceMatcher(None, x, y).ratio() + 0.3 * bool(a[2] and a[2] == b[2]) + 0.1 * (a[3] == b[3])
            if round(score, 6) >= 0.85:
                expected.append((a[0], b[0], round(score, 6)))
    assert whole == sorted(expected)


def test_buyers_fall_into_cells(spark, monkeypatch):
    rng = random.Random(2)
    e = spark.createDataFrame([(f"b{b}", f"s{s:02}", 3) for b in range(4) for s in range(30) if rng.random() < 0.5], "buyer string, supplier string, wins long")
    whole = sorted(map(tuple, D.collusion_pairs(e).collect()))
    monkeypatch.setattr(D, "CELL", 4)
    assert whole and sorted(map(tuple, D.collusion_pairs(e).collect())) == whole


def test_reviews_and_subscriptions(spark):
    q = spark.createDataFrame([("a", "pending", "x", 0.5, "1"), ("b", "pending", "x", 0.9, "1"), ("c", "confirmed", "y", 0.9, "2"), ("d", "pending", "x", 0.5, "2")], "key string, status string, signal_type string, score double, last_seen string")
    assert [r.key for r in V.list_reviews(q, limit=2, offset=1).collect()] == ["b", "d"] and V.count_reviews(q, status="pending", min_score=0.6).first().total == 1
    none = spark.createDataFrame([], "key string, email string, ibge_code string, token_hash string, status string")
    one = V.subscribe(none, spark.createDataFrame([(" A@x ", "1", "t"), ("b@x", "1", "u")], "email string, ibge_code string, token string"))
    one = V.answer(one, spark.createDataFrame([("t",), ("wrong",)], "token string"), "confirmed")
    again = V.subscribe(one, spark.createDataFrame([("a@x", "1", "new")], "email string, ibge_code string, token string"))
    assert [tuple(r) for r in V.confirmed_emails(again).collect()] == [("1", "a@x")] and "new" not in str(again.collect())
    with pytest.raises(ValueError, match="neither"):
        V.cohorts(q, q, False, ("x",))
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert V.digest(a).first() == V.digest(a.select("b", "a").repartition(3)).first() != V.digest(a.distinct()).first()
    assert V.digest(a.limit(0)).first().n_rows == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([rng.normal(), rng.integers(5), 1e9 * rng.random()]))) for g in ("a", "b", None) for _ in range(300)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    parts = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(parts))] for r in Q.quantiles(df, "x", parts, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], parts))
    r = Q.quantiles(df, "x", [0.5]).first()
    assert r.q0 == pytest.approx(np.median([x for _, x in rows if x is not None])) and Q.quantiles(df.limit(0), "x", [0.5]).first().q0 is None


def test_rules_on_what_is_there(spark):
    df = spark.createDataFrame([(str(i),) for i in range(7)], "id string")
    assert Q.check_rules(df, Q.CONTRACT_RULES).collect() == []
    r = Q.check_rules(df, [Q.Rule("low", ("id",), "id < '2'")]).first()
    assert (r.records, r.violations, r.share, r.sample) == (7, 5, 0.7143, ["2", "3", "4", "5", "6"])
    assert Q.check_rules(df.limit(0), [Q.Rule("low", ("id",), "id < '2'")]).first().share == 0.0
    p = Q.profile(spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None)], "x double, s string"), ["x", "s"]).collect()
    assert (p[0].nulls_share, p[0].median, p[0].mean) == (0.3333, 2.0, 2.0) and (p[1].mode, p[1].mode_count) == ("a", 1)


def test_a_forest_isolates_what_lies_apart(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    x[0] = 9
    assert X.isolation_scores(x, x).argmax() == 0
    rows = [(f"{d}{i}", d, float(np.exp(rng.normal())), DAY(2020, 1, 1), DAY(2020, 1, 1) + datetime.timedelta(int(rng.integers(1, 50)))) for d, n in (("a", 40), ("b", 14)) for i in range(n)]
    out = X.forest_rates(spark.createDataFrame(rows, "id string, doc string, amount double, validity_start date, validity_end date")).collect()
    assert [(r.doc, r.contracts) for r in out] == [("a", 40)] and 0 < out[0].forest_rate <= 0.1
    labelled = spark.createDataFrame([(float(i % 2), float(i % 2), float(i % 3)) for i in range(60)], "label double, f double, g double")
    model = X.train_risk(labelled, ["f", "g"], trees=5, depth=3)
    assert {(r.label, r.cri > 0.5) for r in X.risk_of(labelled, model, ["f", "g"]).collect()} == {(0.0, False), (1.0, True)}
    with pytest.raises(ValueError, match="no model"):
        X.risk_of(labelled, None, ["f"])


def test_all_trees_at_once_are_each_by_itself_and_a_supplier_moves_once(spark):
    rng, trees = np.random.default_rng(2), 7
    x = np.column_stack([rng.integers(0, 9, 60), rng.integers(0, 5, 60), np.zeros(60)]).astype(float)
    limit, mean = 6, lambda n: float(X._mean_depth(np.array([n]))[0])

    def depth(row, tree, level=0, place=0, of=x):
        wide = of.max(0) > of.min(0) if len(of) else np.zeros(3, bool)
        if level == limit or not wide.any():
            return level + mean(len(of))
        chances, where = X._draws(trees, 3, limit, 5)[level]
        node = (tree << level) + place
        k = int(np.argmax(wide * chances[:, node]))
        cut = of[:, k].min() + where[node] * (of[:, k].max() - of[:, k].min())
        right = bool(row[k] >= cut)
        return depth(row, tree, level + 1, 2 * place + right, of[(of[:, k] >= cut) == right])

    new = np.vstack([x[:9], [[40.0, -3.0, 1.0]]])
    want = [2 ** (-np.mean([depth(r, t) for t in range(trees)]) / mean(60)) for r in new]
    assert np.allclose(X.isolation_scores(x, new, trees, 5), want)
    day = DAY(2020, 1, 1)
    df = spark.createDataFrame([(str(i), "a", float(i % 7), day, day) for i in range(20)], "id string, doc string, amount double, validity_start date, validity_end date")
    assert "CoGroups" not in X.isolated(df, trees=3)._jdf.queryExecution().toString()


def test_trees_of_a_large_supplier_draw_from_all_its_contracts(spark, monkeypatch):
    day = DAY(2020, 1, 1)
    rng = random.Random(4)
    data = [(f"{i:04}", "a", float(rng.randint(900, 1100)), day, day + datetime.timedelta(rng.randint(25, 35))) for i in range(1500)] + [("9999", "a", 1e9, day, day + datetime.timedelta(9000))]
    df = spark.createDataFrame(data, "id string, doc string, amount double, validity_start date, validity_end date").repartition(3)
    whole = {r.id: r for r in X.isolated(df, trees=40).collect()}
    monkeypatch.setattr(X, "WHOLE", 1000)
    monkeypatch.setattr(X, "TASK_ROWS", 400)
    drawn = {r.id: r for r in X.isolated(df, trees=40).collect()}
    assert drawn.keys() == whole.keys() and drawn["9999"].isolated and max(drawn, key=lambda k: drawn[k].score) == "9999"
    assert sum(r.isolated for r in drawn.values()) <= 150 and np.corrcoef([whole[k].score for k in whole], [drawn[k].score for k in whole])[0, 1] > 0.8
    again = {r.id: r.score for r in X.isolated(df.repartition(5), trees=40).collect()}
    assert again == {k: r.score for k, r in drawn.items()}


def test_dumps_and_listings(spark, tmp_path):
    assert [files.entity_of(x) for x in ("Empresas0.csv", "/a/Socios1.zip", "consulta_cand_2024.zip", "receitas_candidatos_2024_PE.csv", "readme.txt")] == ["companies", "partners", "candidacies", "campaign_donations", None]
    for part in ("BRASIL", "PE"):
        (tmp_path / f"consulta_cand_2024_{part}.csv").write_text(f'"SQ_CANDIDATO";"NM_CANDIDATO"\n"1";"João {part}"\n', encoding="latin-1")
    (tmp_path / "consulta_cand_2020_PE.csv").write_text('"SQ_CANDIDATO";"NM_CANDIDATO"\n"2";"Old"\n', encoding="latin-1")
    assert {(r.NM_CANDIDATO, r.election_year) for r in files.read(spark, "tse", str(tmp_path)).collect()} == {("João BRASIL", 2024), ("Old", 2020)}
    (tmp_path / "top.txt").write_text("NAMESPACE NAME CPU MEM\nns web-1 250m 64Mi\nbroken\n")
    assert [tuple(r) for r in files.read(spark, "pod_listing", str(tmp_path / "top.txt")).collect()] == [("web-1", 250.0, 64 * 1048576.0)]
    with pytest.raises(KeyError, match="no source"):
        files.read(spark, "nowhere", "x")


def test_tables_are_replaced_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    for rows in ([(1, "x"), (2, "y")], [(2, "z"), (3, "w"), (3, "v")], [(2, "z"), (3, "w")]):
        files.upsert(spark, spark.createDataFrame(rows, "id int, v string"), path, "id", buckets=4)
    assert {(r.id, r.v) for r in files.current(spark, path).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    done, wanted = f"{tmp_path}/terms", spark.createDataFrame([("a",), ("b",)], "id string")
    files.checkpoint_terms(wanted, spark.createDataFrame([("a", None)], "id string, terms string"), done)
    assert [tuple(r) for r in spark.read.parquet(done).collect()] == [("a", "[]")] and [r.id for r in files.pending(wanted, done, "id").collect()] == ["b"]
    out = files.write_bronze(wanted, str(tmp_path), "pncp", "2024-01-01")
    assert files.list_bronze(spark, str(tmp_path), "pncp").where("dt = '2024-01-01'").count() >= 1 and spark.read.json(out).count() == 2


def test_exports_have_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    rows = files.export(df, "contracts_daily", str(tmp_path), "2024-01-01").collect()
    import glob
    import hashlib

    for r in rows:
        data = open(glob.glob(f"{tmp_path}/contracts_daily/dt=2024-01-01/*/{r.file}")[0], "rb").read()
        assert (r.sha256, r.bytes, r.rows, r.columns) == (hashlib.sha256(data).hexdigest(), len(data), 2, "a,b")
    with pytest.raises(PermissionError):
        files.export(df, "contract_red_flags", str(tmp_path), "2024-01-01")
    assert files.classify(["contracts_daily", "new", "pod_usage_hourly"]) == (["contracts_daily"], ["new"])
    evidence = spark.createDataFrame([(bytearray(b"x"), "report", "web", DAY(2024, 5, 1), "pdf", {"k": "1"}), (bytearray(b"x"), "report", "web", DAY(2024, 5, 1), "pdf", {"k": "1"})], "content binary, type string, source string, captured_on date, extension string, metadata map<string,string>")
    for _ in range(2):
        keys = {r.key for r in files.store_evidence(evidence, f"{tmp_path}/ev").collect()}
    assert len(keys) == 1 and next(iter(keys)).startswith("evidence/report/web/2024/05/") and files.find_evidence(spark, f"{tmp_path}/ev", k="1").count() == 1 and files.find_evidence(spark, f"{tmp_path}/ev", k="2").count() == 0


def test_steps_are_measured(spark):
    df, seen = Q.measured(spark.createDataFrame([(1, None), (None, None)], "a int, b string"), "load")
    df.collect()
    assert seen.get == {"rows": 2, "empty_rows": 1}
    nodes, edges = Q.lineage(spark, [("load", ["raw"], "silver"), ("mart", ["silver"], "gold")])
    assert nodes.count() == 5 and {(r.source, r.target) for r in edges.collect()} == {("raw", "load"), ("load", "silver"), ("silver", "mart"), ("mart", "gold")}
