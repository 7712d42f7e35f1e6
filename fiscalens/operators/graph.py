"""Ownership graphs and reviewed signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import key_of
from ..functions.rounding import rounded
from .normalizers import partner_key, with_municipality


def trace_ownership(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """All simple paths of 1 to ``max_depth`` ownership edges from the roots (root), every prefix included: root, path, depth."""
    own = edges.where("kind = 'ownership'").select("src", "dst")
    at = roots.select("root", F.array("root").alias("_path"), F.col("root").alias("src"))
    out = None
    for depth in range(1, max_depth + 1):
        at = at.join(own, "src").where(~F.array_contains("_path", F.col("dst"))).select("root", F.concat("_path", F.array("dst")).alias("_path"), F.col("dst").alias("src"))
        level = at.select("root", F.array_join(F.transform("_path", lambda x: x.cast("string")), ">").alias("path"), F.lit(depth).alias("depth"))
        out = level if out is None else out.unionByName(level)
    return out


def partners_of_buyers(c: DataFrame, edges: DataFrame) -> DataFrame:
    """Owners and directors of the companies that a buyer contracted."""
    held = c.where("cnpj is not null").select("siafi", F.col("cnpj").cast("long").alias("dst")).distinct()
    return held.join(edges.select("src", "dst"), "dst").select("siafi", F.col("src").alias("partner")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges by node and kind."""
    ends = edges.select(F.col("src").alias("node"), "kind", F.lit("out").alias("way")).unionByName(edges.select(F.col("dst").alias("node"), "kind", F.lit("in").alias("way")))
    return ends.groupBy("node", "kind").agg(F.count_if(F.col("way") == "out").alias("outgoing"), F.count_if(F.col("way") == "in").alias("incoming"))


# Codes of the registry for roles that direct, and for those that own and direct; any other owns.
DIRECTING = ["05", "08", "10", "16", "17"]
OWNING_AND_DIRECTING = ["28", "49"]


def edge_kinds(role: Column) -> Column:
    """The kinds of edges that a partner's role makes."""
    code = F.lpad(F.trim(F.coalesce(role, F.lit(""))), 2, "0")
    kinds = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(code.isin(OWNING_AND_DIRECTING), kinds("ownership", "directorship")).when(code.isin(DIRECTING), kinds("directorship")).otherwise(kinds("ownership"))


def _once(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key: of several the one with the largest values, whatever their order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def company_graph(companies: DataFrame, partners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the registry's companies and partners.

    vertices: schema (Company or Person), key, name, number, country. edges: kind, key, source, target, role, start_date. A company that
    is a partner is a vertex by its own number, and owns; a person owns, directs or both, as its role says; a named representative is a
    person that directs. A key stands once: what partners say of a company replaces the registry's row.
    """
    p = partners.where(F.coalesce(F.col("cnpj_basico"), F.lit("")) != "").withColumns({"_held": key_of(F.col("cnpj_basico")), "_firm": F.coalesce((F.col("identificador") == "1") & F.col("cnpj_cpf_socio").rlike(r"^\d{14}$"), F.lit(False))})
    holder = key_of(F.substring("cnpj_cpf_socio", 1, 8))
    none = F.lit(None).cast("string")
    agent = partner_key(F.col("cnpj_basico"), F.col("nome_representante"), F.concat(F.lit("REP-"), F.coalesce("qualificacao_representante_legal", F.lit(""))))
    firms, people, agents = p.where("_firm"), p.where("not _firm"), p.where("nome_representante <> ''")
    vertex = lambda df, schema, key, name, number, country, order: df.select(F.lit(schema).alias("schema"), key.alias("key"), F.lit(order).alias("_order"), name.alias("name"), number.alias("number"), country.alias("country"))
    vertices = (
        vertex(companies, "Company", key_of(F.col("cnpj_basico")), F.col("razao_social"), F.col("cnpj_basico"), none, 0)
        .unionByName(vertex(firms, "Company", holder, F.col("nome"), F.substring("cnpj_cpf_socio", 1, 8), none, 1))
        .unionByName(vertex(people, "Person", F.col("partner_id"), F.col("nome"), F.col("cnpj_cpf_socio"), F.col("pais"), 0))
        .unionByName(vertex(agents, "Person", agent, F.col("nome_representante"), F.col("representante_legal"), none, 0)))

    def edge(df: DataFrame, kind: Column, collection: str, key: Column, role: str, start: Column) -> DataFrame:
        source, target = F.concat(F.lit(f"{collection}/"), key), F.concat(F.lit("companies/"), F.col("_held"))
        return df.select(kind.alias("kind"), F.concat(F.lit(f"{collection}_"), key, F.lit("__companies_"), F.col("_held")).alias("key"), source.alias("source"), target.alias("target"), F.col(role).alias("role"), start.alias("start_date"))

    edges = (
        edge(firms, F.lit("ownership"), "companies", holder, "qualificacao", F.col("data_entrada"))
        .unionByName(edge(people.withColumn("_kind", F.explode(edge_kinds(F.col("qualificacao")))), F.col("_kind"), "persons", F.col("partner_id"), "qualificacao", F.col("data_entrada")))
        .unionByName(edge(agents, F.lit("directorship"), "persons", agent, "qualificacao_representante_legal", F.lit(None).cast("date"))))
    return _once(vertices, "schema", "key").drop("_order"), _once(edges, "kind", "key", "source", "target")


def contract_graph(c: DataFrame, places: DataFrame | None = None, supplier_places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of flat contracts: contracts, company suppliers and buyers, with places where they resolve, and who won what.

    vertices: kind, key, name, ibge_code, latitude, longitude. edges: supplier, contract, amount. places (ibge_code, compared_name, uf, latitude,
    longitude) is the reference of municipalities, supplier_places (cnpj, latitude, longitude) the seats of companies.
    """
    nothing = [F.lit(None).cast("string").alias("ibge_code"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude")]
    contracts = c.select(F.lit("contract").alias("kind"), key_of(F.col("id")).alias("key"), F.col("subject").alias("name"), *nothing)
    suppliers = c.where("cnpj is not null").groupBy("cnpj").agg(F.min("legal_name").alias("name"))
    if supplier_places is not None:
        suppliers = suppliers.join(supplier_places.select("cnpj", "latitude", "longitude"), "cnpj", "left").withColumn("ibge_code", F.lit(None).cast("string"))
    else:
        suppliers = suppliers.select("*", *nothing)
    buyers = c.where("siafi is not null").groupBy("siafi").agg(F.max_by(F.struct("agency", "city", "uf"), F.struct("dt", "id")).alias("b")).select("siafi", F.col("b.agency").alias("name"), F.col("b.city").alias("city"), F.col("b.uf").alias("uf"))
    buyers = with_municipality(buyers, places, "city", "uf") if places is not None else buyers.select("*", *nothing)
    columns = ["kind", "key", "name", "ibge_code", "latitude", "longitude"]
    vertices = contracts.unionByName(suppliers.select(F.lit("supplier").alias("kind"), key_of(F.col("cnpj")).alias("key"), "name", "ibge_code", "latitude", "longitude").select(columns))
    vertices = vertices.unionByName(buyers.select(F.lit("buyer").alias("kind"), key_of(F.col("siafi")).alias("key"), "name", "ibge_code", "latitude", "longitude").select(columns))
    won = c.where("cnpj is not null").select(key_of(F.col("cnpj")).alias("supplier"), key_of(F.col("id")).alias("contract"), "amount")
    return vertices, won


def ftm_entities(vertices: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """For each root (a company's number of 8 or 14 digits) that is in the graph: the company, its partners, what it owns, and these
    edges, as entities of the FollowTheMoney vocabulary: root, id, schema, properties (JSON, only what is filled). Each once a root."""
    some = lambda x: F.when(F.coalesce(x.cast("string"), F.lit("")) != "", F.array(x.cast("string")))
    company = F.col("schema") == "Company"
    v = vertices.withColumn("_ref", F.concat(F.when(company, "companies/").otherwise("persons/"), F.col("key")))
    name = lambda ref: F.regexp_replace(F.regexp_replace(ref, "^companies/", "company-"), "^persons/", "person-")
    one = F.when(company, F.to_json(F.struct(some(F.col("name")).alias("name"), some(F.col("number")).alias("registrationNumber")))).otherwise(F.to_json(F.struct(some(F.col("number")).alias("idNumber"), some(F.col("name")).alias("name"), some(F.col("country")).alias("nationality"))))
    v = v.select("_ref", name(F.col("_ref")).alias("id"), "schema", one.alias("properties"))
    owns, ends = F.col("kind") == "ownership", [F.array(name(F.col(x))) for x in ("source", "target")]
    link = F.when(owns, F.to_json(F.struct(ends[1].alias("asset"), ends[0].alias("owner"), some(F.col("role")).alias("role"), some(F.col("start_date")).alias("startDate")))).otherwise(F.to_json(F.struct(ends[0].alias("director"), ends[1].alias("organization"), some(F.col("role")).alias("role"), some(F.col("start_date")).alias("startDate"))))
    e = edges.select("source", "target", "kind", F.concat("kind", F.lit("-"), "key").alias("id"), F.initcap("kind").alias("schema"), link.alias("properties"))
    asked = roots.select(F.concat(F.lit("companies/"), F.substring("root", 1, 8)).alias("_root"), "root").join(v.select(F.col("_ref").alias("_root")), "_root", "left_semi")
    near = asked.join(e, F.col("_root") == F.col("target")).select("root", F.col("source").alias("_ref"), "id", "schema", "properties")
    near = near.unionByName(asked.join(e.where("kind = 'ownership'"), F.col("_root") == F.col("source")).select("root", F.col("target").alias("_ref"), "id", "schema", "properties"))
    around = near.select("root", "_ref").unionByName(asked.select("root", F.col("_root").alias("_ref"))).distinct()
    return around.join(v, "_ref").select("root", "id", "schema", "properties").unionByName(near.select("root", "id", "schema", "properties")).distinct()


# Allowed transitions of a reviewed signal; published ends.
TRANSITIONS = [("pending", "confirmed"), ("pending", "rejected"), ("confirmed", "published"), ("confirmed", "rejected"), ("rejected", "confirmed")]


def register(queue: DataFrame, signals: DataFrame) -> DataFrame:
    """New signals are queued as pending; known ones (by key) keep their status and get the new score and last_seen."""
    new = signals.select("key", F.col("score").alias("_score"), F.col("seen").alias("_seen"))
    return queue.join(new, "key", "full_outer").select("key", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("_score", "score").alias("score"), F.coalesce("_seen", "last_seen").alias("last_seen"))


def transition(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """queue (key, status, history) after the asked changes (key, to, reviewer, reason) that are allowed; rejecting needs a reason."""
    ok = F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TRANSITIONS]), lambda t: (t["a"] == F.col("status")) & (t["b"] == F.col("to")))
    ok &= (F.trim("reviewer") != "") & ((F.col("to") != "rejected") | (F.trim("reason") != ""))
    moved = queue.join(asked, "key", "left").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return moved.select("key", F.when(F.col("_ok"), F.col("to")).otherwise(F.col("status")).alias("status"), F.when(F.col("_ok"), F.array_append("history", F.concat_ws(":", "status", "to", "reviewer"))).otherwise(F.col("history")).alias("history"))


def precision_report(reviewed: DataFrame) -> DataFrame:
    """By signal type the signals of each status, and confirmed / (confirmed + rejected), NULL if there are none."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pending", "confirmed", "rejected")}
    out = reviewed.groupBy("signal_type").agg(*[v.alias(k) for k, v in n.items()])
    return out.withColumn("precision", rounded(F.col("confirmed") / F.nullif(F.col("confirmed") + F.col("rejected"), F.lit(0))))


def signal_places(c: DataFrame) -> DataFrame:
    """A supplier's place: the most frequent town of its buyers, ties by name."""
    n = c.where("doc is not null").groupBy("doc", "city", "uf").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "city"))).where("_r = 1").drop("_r")


def alerts(signals: DataFrame, least: float = 0.7, top_k: int = 50) -> DataFrame:
    return signals.where(F.col("score") >= least).orderBy(F.desc("score"), "signal_type", "entity_id").limit(top_k).withColumn("priority", F.when(F.col("score") >= 0.9, "critical").otherwise("high"))


def evaluation(scored: DataFrame, threshold: float) -> DataFrame:
    """scored (score, truth) as counts, precision (1 without predictions) and recall (0 without positives)."""
    hit = F.col("score") >= threshold
    row = scored.agg(F.count_if(hit & F.col("truth")).alias("tp"), F.count_if(hit & ~F.col("truth")).alias("fp"), F.count_if(~hit & F.col("truth")).alias("fn"), F.count_if(~hit & ~F.col("truth")).alias("tn"))
    ratio = lambda a, b, other: rounded(F.coalesce(a / F.nullif(a + b, F.lit(0)), F.lit(other)))
    return row.withColumn("precision", ratio(F.col("tp"), F.col("fp"), 1.0)).withColumn("recall", ratio(F.col("tp"), F.col("fn"), 0.0))
