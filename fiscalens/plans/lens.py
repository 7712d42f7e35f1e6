"""The driver's tables seen as procurement data: contracts, sanctions, payloads, donations, places, edges, notices, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Lens values: priority to modality, status letter to status, market segment to level of government.
MODALITY = {"1-URGENT": "dispensa", "2-HIGH": "inexigibilidade", "3-MEDIUM": "pregao", "4-NOT SPECIFIED": "not_informed", "5-LOW": "concorrencia"}
STATUS = {"F": "completed", "O": "active", "P": "suspended"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(column: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]


def supplier_cnpj(key: Column) -> Column:
    return F.when(key % 10 != 9, F.lpad(key.cast("string"), 14, "0"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table of contracts, written once a session."""
    return stored(spark, sf_dir, "contracts", lambda: made_contracts(spark, sf_dir))


def made_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract a line item. A tenth of the suppliers are persons (cpf), some contracts name no supplier, some last long, and the
    agencies have a second name in some."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    named = F.col("l_partkey") % 50 != 0
    key = F.col("l_suppkey")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").cast("string").alias("process_number"),
            F.concat(F.lit("Supply of part "), F.col("l_partkey").cast("string")).alias("subject"),
            F.col("l_extendedprice").cast("decimal(38,10)").alias("amount"),
            F.to_date("o_orderdate").alias("signature_date"), F.to_date("o_orderdate").alias("validity_start"), F.date_add(F.to_date("l_shipdate"), F.when(F.col("l_partkey") % 97 == 0, 20000).otherwise(0)).alias("validity_end"),
            F.struct(F.col("o_custkey").cast("string").alias("siafi_code"), F.when(F.col("l_linenumber") == 3, F.concat("c_name", F.lit(" (annex)"))).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "municipal").otherwise("federal").alias("government_level"), F.col("r_name").alias("uf"), F.col("n_name").alias("city")).alias("buyer"),
            F.struct(
                F.when(named, supplier_cnpj(key)).alias("cnpj"),
                F.when(named & (key % 10 == 9), F.lpad(key.cast("string"), 11, "0")).alias("cpf"),
                F.when(named, F.concat(F.lit("Supplier "), key.cast("string"))).alias("legal_name"),
            ).alias("supplier"),
            case(F.col("o_orderpriority"), MODALITY).alias("modality"), case(F.col("o_orderstatus"), STATUS).alias("status"),
            F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("dt"),
        )
    )


def flat(df: DataFrame) -> DataFrame:
    """Contracts with the fields of buyer and supplier as columns."""
    return df.select("*", F.col("buyer.siafi_code").alias("siafi"), F.col("buyer.name").alias("agency"), F.col("buyer.government_level").alias("level"), F.col("buyer.uf").alias("uf"), F.col("buyer.city").alias("city"),
                     F.col("supplier.cnpj").alias("cnpj"), F.col("supplier.cpf").alias("cpf"), F.coalesce("supplier.cnpj", "supplier.cpf").alias("doc"), F.col("supplier.legal_name").alias("legal_name")).drop("buyer", "supplier")


CONTRACTS = """contracts AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(l_orderkey AS VARCHAR) AS process_number,
    'Supply of part ' || l_partkey AS subject, CAST(l_extendedprice AS DECIMAL(38,10)) AS amount,
    CAST(o_orderdate AS DATE) AS signature_date, CAST(o_orderdate AS DATE) AS validity_start, CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 97 = 0 THEN 20000 ELSE 0 END AS validity_end,
    CAST(o_custkey AS VARCHAR) AS siafi, CASE WHEN l_linenumber = 3 THEN c_name || ' (annex)' ELSE c_name END AS agency, CASE WHEN c_mktsegment = 'BUILDING' THEN 'municipal' ELSE 'federal' END AS level, r_name AS uf, n_name AS city,
    CASE WHEN l_partkey % 50 <> 0 AND l_suppkey % 10 <> 9 THEN lpad(CAST(l_suppkey AS VARCHAR), 14, '0') END AS cnpj,
    CASE WHEN l_partkey % 50 <> 0 AND l_suppkey % 10 = 9 THEN lpad(CAST(l_suppkey AS VARCHAR), 11, '0') END AS cpf,
    CASE WHEN l_partkey % 50 <> 0 THEN CASE WHEN l_suppkey % 10 <> 9 THEN lpad(CAST(l_suppkey AS VARCHAR), 14, '0') ELSE lpad(CAST(l_suppkey AS VARCHAR), 11, '0') END END AS doc,
    CASE WHEN l_partkey % 50 <> 0 THEN 'Supplier ' || l_suppkey END AS legal_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'dispensa' WHEN '2-HIGH' THEN 'inexigibilidade' WHEN '3-MEDIUM' THEN 'pregao' WHEN '4-NOT SPECIFIED' THEN 'not_informed' WHEN '5-LOW' THEN 'concorrencia' END AS modality,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' WHEN 'P' THEN 'suspended' END AS status,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS dt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


#: Crawls of an order: number, days after the order, which orders, and whether it is a crawl of updates.
CRAWLS = [(1, 0, 1, False), (2, 30, 3, True), (3, 10, 5, False), (4, 0, 7, False)]


def raw_payloads(spark: SparkSession, sf_dir: str, updates: bool = False) -> DataFrame:
    """Bronze (dt, ingested_at, payload_json: an array of contracts as the source has them), a row an order and crawl. Orders are crawled
    again, some on the same day, with higher values; some are never crawled."""
    return stored(spark, sf_dir, f"raw-{'updates' if updates else 'contracts'}", lambda: made_payloads(spark, sf_dir, updates))


def made_payloads(spark: SparkSession, sf_dir: str, updates: bool) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_orderkey % 61 <> 0")

    def crawl(number: int, days: int, every: int) -> DataFrame:
        final = ((F.col("l_quantity") + (F.col("l_partkey") % 3) - 1).cast("int") * number).cast("string")
        item = F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("numeroControlePNCP"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00").alias("dataAberturaProposta"),
            F.when(F.col("l_linenumber") != 4, F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("l_partkey") % 12).cast("int")), "yyyy-MM-dd'T'00:00:00")).alias("dataEncerramentoProposta"),
            F.col("l_quantity").cast("int").cast("string").alias("valorInicialCompra"), final.alias("valorTotalHomologado"),
            F.col("l_quantity").cast("int").cast("string").alias("valorInicial"), final.alias("valorAcumulado"),
            F.date_format(F.date_add(F.to_date("l_shipdate"), F.when(F.col("l_partkey") % 2 == 0, 10 * (number - 1)).otherwise(0)), "yyyy-MM-dd").alias("dataVigenciaFim"),
            (F.col("l_linenumber") + number).cast("string").alias("numeroRetificacao"), F.lit("Objeto").alias("objetoCompra"))
        dt = F.date_add(F.to_date("o_orderdate"), days)
        return line.where(F.col("o_orderkey") % every == 0).select("o_orderkey", dt.alias("dt"), (dt.cast("timestamp") + F.make_interval(hours=F.lit(number))).alias("ingested_at"), item.alias("item"))

    found = None
    for number, days, every, of_updates in CRAWLS:
        if of_updates == updates:
            part = crawl(number, days, every)
            found = part if found is None else found.unionByName(part)
    return found.groupBy("o_orderkey", "dt", "ingested_at").agg(F.to_json(F.collect_list("item")).alias("payload_json")).select("dt", "ingested_at", "payload_json")


#: The same items without the way through JSON; seq orders an item's crawls.
ITEMS = """items AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, u AS is_update, ((CAST(o_orderdate AS DATE) + days) - DATE '1900-01-01') * 10 + f AS seq, CAST(o_orderdate AS DATE) AS opened,
    CASE WHEN l_linenumber <> 4 THEN CAST(o_orderdate AS DATE) + CAST(l_partkey % 12 AS INTEGER) END AS closed,
    CAST(trunc(l_quantity) AS INTEGER) AS initial, CAST(trunc(l_quantity + (l_partkey % 3) - 1) AS INTEGER) * f AS final,
    CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 2 = 0 THEN 10 * (f - 1) ELSE 0 END AS ends, l_linenumber + f AS rectifications
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (VALUES (1, 0, 1, false), (2, 30, 3, true), (3, 10, 5, false), (4, 0, 7, false)) AS crawl(f, days, every, u) ON o_orderkey % every = 0
  WHERE o_orderkey % 61 <> 0)"""


def sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh supplier is sanctioned in one of three lists, for a time or openly; some sanctions have no start."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where(key % 7 == 0)
    return s.select(
        F.concat(F.lit("S"), key.cast("string")).alias("id"), F.element_at(F.array(F.lit("ceis"), F.lit("cnep"), F.lit("ceaf")), (key % 3 + 1).cast("int")).alias("list_name"),
        supplier_cnpj(key).alias("cnpj"), F.when(key % 10 == 9, F.lpad(key.cast("string"), 11, "0")).alias("cpf"), F.concat(F.lit("Supplier "), key.cast("string")).alias("sanctioned_name"),
        F.when(key % 5 != 0, F.date_add(F.lit("1994-01-01").cast("date"), (key % 500).cast("int"))).alias("start_date"),
        F.when(key % 2 == 0, F.date_add(F.lit("1996-01-01").cast("date"), (key % 700).cast("int"))).alias("end_date"))


SANCTIONS = """sanctions AS (
  SELECT 'S' || s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'ceis' WHEN 1 THEN 'cnep' ELSE 'ceaf' END AS list_name,
    CASE WHEN s_suppkey % 10 <> 9 THEN lpad(CAST(s_suppkey AS VARCHAR), 14, '0') ELSE lpad(CAST(s_suppkey AS VARCHAR), 11, '0') END AS doc, 'Supplier ' || s_suppkey AS sanctioned_name,
    CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1994-01-01' + CAST(s_suppkey % 500 AS INTEGER) END AS start_date, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1996-01-01' + CAST(s_suppkey % 700 AS INTEGER) END AS end_date
  FROM supplier WHERE s_suppkey % 7 = 0)"""


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.lpad(key.cast("string"), 7, "0").alias("ibge_code"), F.col("n_name").alias("name"), F.col("r_name").alias("uf"), (key * 1.25 - 20).alias("latitude"), (key * -0.75 - 40).alias("longitude"))


MUNICIPALITIES = """municipalities AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS ibge_code, n_name AS name, r_name AS uf, CAST(n_nationkey * 1.25 - 20 AS DOUBLE) AS latitude, CAST(n_nationkey * -0.75 - 40 AS DOUBLE) AS longitude
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where(key % 10 != 9).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(supplier_cnpj(key).alias("cnpj"), F.col("n_name").alias("city"), F.col("r_name").alias("uf"), (key % 4 != 0).alias("is_matriz"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership and directorship between suppliers by key arithmetic: trees, and a cycle."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(key)
    top = s.agg(F.max("s_suppkey").alias("top"))
    owns = s.crossJoin(F.broadcast(top)).select(key.alias("src"), F.explode(F.array(key * 2, key * 3)).alias("dst"), "top").where("dst <= top").select("src", "dst", F.lit("ownership").alias("kind"))
    back = s.where(key == 8).select(key.alias("src"), F.lit(2).cast("long").alias("dst"), F.lit("ownership").alias("kind"))
    runs = s.where(key % 5 == 0).select((key + 1).alias("src"), key.alias("dst"), F.lit("directorship").alias("kind"))
    return owns.unionByName(back).unionByName(runs)


EDGES = """edges AS (
  SELECT s_suppkey AS src, s_suppkey * k AS dst, 'ownership' AS kind FROM supplier, (VALUES (2), (3)) AS f(k) WHERE s_suppkey * k <= (SELECT max(s_suppkey) FROM supplier)
  UNION ALL SELECT s_suppkey, 2, 'ownership' FROM supplier WHERE s_suppkey = 8
  UNION ALL SELECT s_suppkey + 1, s_suppkey, 'directorship' FROM supplier WHERE s_suppkey % 5 = 0)"""


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the suppliers gave money to the candidate of its nation, some through a party. Two monthly dumps, the older one with half
    of the sums."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where(key % 4 < 2)
    doc = F.when(key % 10 != 9, F.lpad(key.cast("string"), 14, "0")).otherwise(F.lpad(key.cast("string"), 11, "0"))
    through = key % 8 == 0
    dump = F.explode(F.array(F.struct(F.lit("2024-01-01").alias("dt"), F.lit(1).alias("part")), F.struct(F.lit("2024-02-01").alias("dt"), F.lit(2).alias("part"))))
    return s.select("*", dump.alias("_dump")).select(
        F.when(through, F.lit("00000000000191")).otherwise(doc).alias("donor_document"), F.when(through, doc).alias("donor_origin_document"), ((key % 9) * 200 * F.col("_dump.part")).cast("decimal(38,2)").alias("amount"),
        F.col("s_nationkey").cast("string").alias("candidate_sequential"), F.lit(1992).alias("election_year"), F.date_add(F.lit("1992-08-01").cast("date"), (key % 60).cast("int")).alias("donation_date"), F.col("_dump.dt").alias("dt"))


def candidacies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return n.select(key.cast("string").alias("candidate_sequential"), F.lit(1992).alias("election_year"), F.concat(F.lit("Candidate "), key.cast("string")).alias("candidate_name"), F.concat(F.lit("P"), (key % 3).cast("string")).alias("party"), F.lit("Prefeito").alias("office"),
                    F.when(key % 6 != 0, "ELEITO").otherwise("NÃO ELEITO").alias("totalization_status"), F.lpad(key.cast("string"), 5, "0").alias("ue_code"), F.initcap("n_name").alias("ue_name"), F.col("r_name").alias("uf"), F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))).alias("dt"))


def latest(df: DataFrame) -> DataFrame:
    return df.where("dt = '2024-02-01'")


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(key % 3 != 0).select(F.lpad(key.cast("string"), 5, "0").alias("ue_code"), F.concat(F.lit("SI"), key.cast("string")).alias("siafi_code"), F.lpad(key.cast("string"), 7, "0").alias("ibge_code"))


def pod_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze snapshots of containers: the events of a minute as samples, some without a pod."""
    k = F.get_json_object("props", "$.k").cast("double")
    pod = F.when(F.col("user_id") % 50 != 0, F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")))
    sample = F.struct(pod.alias("pod"), k.alias("cpu_millicores"), (k * 1048576 + F.col("user_id") % 7).alias("memory_bytes"))
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").alias("ingested_at")).agg(F.to_json(F.collect_list(sample)).alias("payload_json"))


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("viewer", "view-%", 50.0, 64e6), ("shop", "purchase-%", 80.0, 48e6), ("first", "%-1", 40.0, 0.0), ("errors", "error-%", 0.0, 32e6)], "component string, pod_pattern string, request_cpu double, request_memory double")


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of pipeline steps: the events as step runs."""
    k, steps = F.get_json_object("props", "$.k").cast("double"), F.array(*[F.lit(x) for x in ("crawl_pncp", "collect_files", "normalize", "crawlers", "persist")])
    return table(spark, sf_dir, "events").select(F.col("ts").alias("started_at"), F.element_at(steps, (F.col("user_id") % 5 + 1).cast("int")).alias("step"), F.col("event_type").alias("pipeline"), k.alias("seconds"), (F.col("user_id") * 3).cast("long").alias("rows"), F.when(F.col("user_id") % 11 == 0, 1).otherwise(0).cast("long").alias("errors"))


METRICS = """metrics AS (SELECT ts AS started_at, CASE user_id % 5 WHEN 0 THEN 'crawl_pncp' WHEN 1 THEN 'collect_files' WHEN 2 THEN 'normalize' WHEN 3 THEN 'crawlers' ELSE 'persist' END AS step, event_type AS pipeline,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS seconds, CAST(user_id * 3 AS BIGINT) AS rows, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS errors FROM events)"""


def contract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's registered terms: its line items as amendments, adjustments and reductions; every ninth query failed, and every tenth
    order has none."""
    line, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    kind = F.when(F.col("l_linenumber") % 3 != 0, "Termo Aditivo").otherwise("Termo de Apostilamento")
    term = F.struct(kind.alias("tipoTermoContratoNome"), (F.col("l_partkey") % 2 == 0).alias("qualificacaoAcrescimoSupressao"), (F.col("l_partkey") % 3 == 0).alias("qualificacaoVigencia"), ((F.col("l_quantity").cast("int") - 25).cast("string")).alias("valorAcrescido"), F.when(F.col("l_linenumber") != 4, (F.col("l_suppkey") % 30 - 9).cast("string")).alias("prazoAditadoDias"))
    found = line.groupBy(key.alias("_k")).agg(F.to_json(F.collect_list(term)).alias("_t"))
    return found.select(F.col("_k").cast("string").alias("id"), F.when(F.col("_k") % 9 == 0, None).when(F.col("_k") % 10 == 0, "[]").otherwise(F.col("_t")).alias("terms"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as notices of their source, some with the number of their process."""
    number = F.concat(F.lit("Processo nº 12"), F.lpad((F.col("doc_id") % 3).cast("string"), 4, "0"), F.lit("/2020 "))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(number, "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("territory_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("date"), text.alias("text"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons whose names and documents recur."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("Person "), (key % 900).cast("string")).alias("name"), F.when(key % 3 == 0, F.lpad((key % 900).cast("string"), 11, "1")).alias("document"), (F.col("c_nationkey") % 4).cast("string").alias("age_range"))


def sql(*parts: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + query
