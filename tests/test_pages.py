"""Paged sources: batch and stream readers over folders and HTTP, the recorder, and restarts."""

import http.server
import json
import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fiscalens.functions.storage import shared_dir
from fiscalens.sources import files
from fiscalens.sources.pages import fetch, page_stream, pages, record_pages, records_of


def put(folder, window, page, records, left=None):
    (folder / window).mkdir(parents=True, exist_ok=True)
    body = {"data": records} | ({} if left is None else {"paginasRestantes": left})
    (folder / window / f"{page}.json").write_text(json.dumps(body), encoding="utf-8")


def test_a_page_may_be_a_list_an_object_or_nothing():
    assert records_of(b'[{"a": "\xc3\xa9"}]') == (['{"a": "é"}'], False)
    assert records_of(b'{"data": [1, 2], "paginasRestantes": 0}') == (["1", "2"], True)
    assert records_of(b'{"resultado": []}') == ([], True) and records_of(b"") == ([], True) and records_of(None) == ([], True) and records_of(b'{"other": 1}') == ([], True)


def test_windows_end_at_an_absent_an_empty_or_a_last_page(spark, tmp_path):
    for page in range(1, 12):
        put(tmp_path, "2024-01-01", page, [{"n": page}, {"n": -page}])
    put(tmp_path, "2024-01-02", 1, [{"n": 1}])
    put(tmp_path, "2024-01-02", 2, [])
    put(tmp_path, "2024-01-02", 3, [{"n": 99}])
    put(tmp_path, "2024-01-03", 1, [{"n": 7}], left=0)
    (tmp_path / "2024-01-04").mkdir()
    for stripes in (1, 2, 7):
        found = Counter((r.window, r.page, r.item, json.loads(r.record)["n"]) for r in pages(spark, str(tmp_path), stripes=stripes).collect() if r.page < 3 or r.window < "2024-01-02")
        assert found == Counter([("2024-01-01", p, i, (1, -1)[i] * p) for p in range(1, 12) for i in (0, 1)] + [("2024-01-02", 1, 0, 1), ("2024-01-03", 1, 0, 7)])
    assert {r.page for r in pages(spark, str(tmp_path), windows="2024-01-01", after='["2024-01-01", 9]').collect()} == {9, 10, 11}
    assert pages(spark, str(tmp_path / "none")).count() == 0


def test_filters_on_windows_reach_the_source(spark, tmp_path):
    for w in ("a", "b", "c"):
        put(tmp_path, w, 1, [{"w": w}])
    assert pages(spark, str(tmp_path), stripes=1).where("window = 'b'").rdd.getNumPartitions() == 1
    assert {r.window for r in pages(spark, str(tmp_path)).where("window in ('a', 'c') and item = 0").collect()} == {"a", "c"}


def test_a_restarted_stream_reads_each_page_once(spark, tmp_path):
    landing, out, state = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        page_stream(spark, str(landing), stripes=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return Counter((r.window, r.page) for r in spark.read.parquet(out).collect())

    for page in (1, 2, 3):
        put(landing, "2024-01-01", page, [{"p": page}])
    first = run()
    assert first == {("2024-01-01", p): 1 for p in (1, 2, 3)}
    assert run() == first
    for page in (4, 5):  # a later call for the same day, and the days behind it
        put(landing, "2024-01-01", page, [{"p": page}])
    for page in range(1, 8):
        put(landing, "2024-01-03", page, [{"p": page}])
    put(landing, "2024-01-02", 1, [{"p": 1}])
    want = {("2024-01-01", p): 1 for p in range(1, 6)} | {("2024-01-02", 1): 1} | {("2024-01-03", p): 1 for p in range(1, 8)}
    assert run() == want
    put(landing, "2024-01-03", 8, [{"p": 8}])
    assert run() == want | {("2024-01-03", 8): 1}


def test_recorded_pages_come_back(spark, tmp_path):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("w"), "id", F.lit("é").alias("t"))
    record_pages(df.repartition(5), str(tmp_path), "w", per_page=64)
    back = pages(spark, str(tmp_path)).select("window", "page", "item", F.from_json("record", "id long, t string").alias("r")).select("window", "page", "item", "r.*")
    assert sorted(map(tuple, back.select("window", "id", "t").collect())) == sorted(map(tuple, df.collect()))
    by = back.groupBy("window").agg(F.max("page").alias("last"), F.countDistinct("page").alias("n"), F.max("item").alias("item")).collect()
    assert all(r.last == r.n and r.item < 64 for r in by)


def test_recorded_pages_are_packed_and_rows_stay_in_their_tasks(spark, tmp_path):
    df = spark.range(3000, numPartitions=3).select(F.concat(F.lit("w"), (F.col("id") % 2).cast("string")).alias("w"), "id", F.lit("the same long text in every record " * 8).alias("t"))
    folders = lambda: {p for p in os.listdir(f"{shared_dir(spark)}/tables")} if os.path.isdir(f"{shared_dir(spark)}/tables") else set()
    before = folders()
    record_pages(df, str(tmp_path), "w", per_page=200, first_page=5)
    assert folders() == before  # nothing was written besides the pages
    found = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert found == sorted(f"w{w}/{k}.json.zst" for w in (0, 1) for k in range(5, 14)) and sum(p.stat().st_size for p in tmp_path.rglob("*.zst")) < 3000 * 30
    back = pages(spark, str(tmp_path), first_page=5).select("window", F.from_json("record", "id long, t string").alias("r")).select("window", "r.*")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    put(tmp_path, "w0", 14, [{"id": 7}])  # one that is not packed
    assert pages(spark, str(tmp_path), first_page=5).count() == 3001


@pytest.fixture
def server():
    asked = Counter()

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            _, day, page = self.path.split("/")
            asked[day, int(page)] += 1
            if day == "2024-01-02" and page == "1" and asked[day, 1] < 3:
                self.send_response(503)
                self.end_headers()
                return
            if day == "2024-01-03":
                self.send_response(403)
                self.end_headers()
                return
            n = {"2024-01-01": 5, "2024-01-02": 2}.get(day, 0)
            self.send_response(200 if int(page) <= n else 204)
            self.end_headers()
            if int(page) <= n:
                self.wfile.write(json.dumps({"data": [{"day": day, "page": int(page)}], "paginasRestantes": n - int(page)}).encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{window}}/{{page}}", asked
    s.shutdown()


def test_pages_over_http(spark, server):
    url, asked = server
    options = {"from": "2023-12-31", "to": "2024-01-02", "wait": "0.01"}
    found = Counter((json.loads(r.record)["day"], json.loads(r.record)["page"]) for r in pages(spark, url, **options).collect())
    assert found == Counter([("2024-01-01", p) for p in range(1, 6)] + [("2024-01-02", p) for p in (1, 2)]) and asked["2024-01-02", 1] == 3
    with pytest.raises(Exception, match="403"):
        fetch(url, "2024-01-03", 1, wait=0.01)


def test_transparency_contracts_have_one_supplier(spark, tmp_path):
    put(tmp_path, "26000", 1, [{"id": 1, "valorInicial": "1,5", "contratado": {"nome": "A"}}, {"id": 2, "fornecedores": [{"nome": "B"}, {"nome": "C"}]}, {"id": 3, "fornecedor": {"nome": "D"}}])
    found = files.read(spark, "transparency_pages", str(tmp_path))
    assert {r.id: r.fornecedor.nome for r in found.collect()} == {1: "A", 2: "B", 3: "D"} and "fornecedores" not in found.columns
