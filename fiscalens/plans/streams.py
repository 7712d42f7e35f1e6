"""Streams over the table of events, run to what is there now, a run of all detectors, forests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import rounded_sql as R
from ..operators import detectors as D
from ..operators import forest as X
from ..operators.run import run_detection
from ..streaming import events as E
from . import lens as L
from .detectors import DUR, GEO, HHI, IQR, PAIRS, POL, RATE, benford
from .marts import c
from .others import NOTICES, SCREENED, hidden_sanctions

latest = lambda s, d: E.finished_table(s, lambda path, state: E.upsert_batches(E.opened(s, d).select("user_id", "ts", "event_id", "event_type"), path, "user_id", "ts", state)).select("user_id", "ts", "event_id", "event_type")
forest = lambda s, d: X.forest_rates(c(s, d))


def planted_outliers(s, d):
    """Of every supplier the first contract is made huge and endless; how many suppliers there are with a forest, and how many of these
    contracts it isolates."""
    t = c(s, d).where("doc is not null")
    first = t.groupBy("doc").agg(F.min("id").alias("_first"))
    t = t.join(first, "doc").withColumn("_own", F.col("id") == F.col("_first"))
    t = t.withColumn("amount", F.when(F.col("_own"), F.lit(10**12).cast("decimal(38,10)")).otherwise(F.col("amount"))).withColumn("validity_end", F.when(F.col("_own"), F.date_add("validity_start", 90_000)).otherwise(F.col("validity_end")))
    return X.isolated(t, trees=50).join(first, "doc").where("id = _first").agg(F.count(F.lit(1)).alias("suppliers"), F.count_if("isolated").alias("found"))


def forest_risk(s, d):
    """Contracts' risk by a forest trained on which of them were urgent."""
    x = c(s, d).select("id", (F.col("modality") == "dispensa").cast("double").alias("label"), (F.col("amount") > 50000).cast("double").alias("large"), F.col("cpf").isNotNull().cast("double").alias("person"), (F.datediff("validity_end", "validity_start") < 30).cast("double").alias("short"))
    features = ["large", "person", "short"]
    return X.risk_of(x, X.train_risk(x, features, trees=20, depth=5), features).select("id", "cri")


def detection(s, d, **how):
    """A run of all detectors but the forest."""
    listed = hidden_sanctions(s, d).withColumn("document", F.lit(None).cast("string"))
    return run_detection(c(s, d), L.sanctions(s, d), L.establishments(s, d), L.municipalities(s, d), L.latest(L.donations(s, d)), L.latest(L.candidacies(s, d)), listed, L.notices(s, d), min_wins=2, least_share=0.0005, first="1993-01-01", last="1996-12-31", **how)


def of(**fields: str) -> str:
    """The details as JSON; values are SQL that gives JSON text."""
    return "'{' || " + " || ',' || ".join(f"""'"{name}":' || {x}""" for name, x in sorted(fields.items())) + " || '}'"


dec = lambda x, n=4: f"CAST(CAST({x} AS DECIMAL(38,{n})) AS VARCHAR)"
txt = lambda x: f"""'"' || {x} || '"'"""
lst = lambda x: f"""'["' || replace({x}, ',', '","') || '"]'"""
RUN = [L.CONTRACTS, L.SANCTIONS, L.MUNICIPALITIES, GEO, POL, PAIRS, benford(), RATE, HHI, DUR, IQR, f"cs AS ({NOTICES})", f"""al AS (
      SELECT 'supplier' AS entity_type, doc AS entity_id, 'anomalous_price' AS signal_type, deviation AS score, {of(benford_deviation=dec('deviation'), contracts='n', p_value=dec('p_value'), min_contracts="'10'")} AS details FROM bf
      UNION ALL SELECT 'supplier', doc, 'single_bid', rate, {of(contracts='contracts', rate=dec('rate'), min_contracts="'3'")} FROM rt WHERE rate > 0 AND contracts >= 3
      UNION ALL SELECT 'buyer', siafi, 'concentration', hhi, {of(contracts='contracts', hhi=dec('hhi'), suppliers='suppliers', min_contracts="'3'")} FROM hh WHERE contracts >= 3
      UNION ALL SELECT 'supplier', doc, 'anomalous_duration', sc, {of(contracts='n', method=txt("'iqr'"), outlier_share=dec('sc'), min_contracts="'3'")} FROM (SELECT doc, count(*) AS n, {R("avg(CASE WHEN outlier THEN 1.0 ELSE 0.0 END)")} AS sc FROM oi WHERE doc IS NOT NULL AND duration IS NOT NULL GROUP BY doc HAVING count(*) >= 3) WHERE sc > 0
      UNION ALL SELECT 'supplier', doc, 'sanctioned_supplier', 1.0::DOUBLE, {of(contracts='k', lists=lst('l'), sanctions=lst('i'))} FROM (SELECT c.doc, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS i, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS l, count(DISTINCT c.id) AS k FROM contracts c JOIN sanctions s ON c.doc = s.doc AND signature_date BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31') GROUP BY c.doc)
      UNION ALL SELECT 'supplier', entity, 'sanctioned_name_match', score, {of(contracts='contracts', list=txt('list_name'), sanctions='sanctions')} FROM ({SCREENED})
      UNION ALL SELECT 'supplier', cnpj, 'anomalous_geography', {R('least(1.0, km / 1000)')}, {of(contracts='contracts', contracts_total_brl=dec('total_amount', 2), distance_km=dec(R('km', 6), 6), ibge_code=txt('ibge_code'), max_distance_km="'100.0000'")} FROM gg WHERE km > 100
      UNION ALL SELECT 'supplier', doc, 'political_connection', score, NULL FROM pl
      UNION ALL SELECT 'notice_pair', sha256(least(CAST(doc_id AS VARCHAR), CAST(old_id AS VARCHAR)) || '+' || greatest(CAST(doc_id AS VARCHAR), CAST(old_id AS VARCHAR))), 'notice_clone', {R('similarity')}, {of(notice='doc_id', older_notice='old_id', similarity=dec('similarity', 6), threshold="'0.8500'")} FROM cs
      UNION ALL SELECT * FROM (SELECT 'supplier_pair', s1 || '+' || s2, 'collusion', 1.0::DOUBLE, {of(buyers=lst('buyers'), min_buyers="'2'", min_wins="'2'", suppliers=lst("s1 || ',' || s2"), wins_sum='CAST(wins_sum AS BIGINT)')} FROM pr ORDER BY buyer_count DESC, wins_sum DESC, s1, s2 LIMIT 500))""",
    "pj AS (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM el WHERE supplier IN (SELECT supplier FROM el GROUP BY supplier HAVING count(DISTINCT buyer) >= 2) GROUP BY buyer))"]
local = lambda df, *times: df.withColumns({x: F.col(x).cast("timestamp_ntz") for x in times})
QUERIES = {
    "stream_hourly": lambda s, d: local(E.finished(s, E.hourly(E.opened(s, d)), "complete"), "hour"),
    "stream_sessions": lambda s, d: local(E.finished(s, E.sessions(E.opened(s, d)), "complete"), "started", "ended"),
    "stream_first_seen": lambda s, d: E.finished(s, E.first_seen(E.opened(s, d).select("event_id", "ts")), "append").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events")),
    "stream_sights": lambda s, d: local(E.finished(s, E.sights(E.opened(s, d).select("user_id", "ts")), "update").groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("events").alias("events")), "first_seen", "last_seen"),
    "stream_latest": lambda s, d: local(latest(s, d), "ts"),
    "run_detection": lambda s, d: detection(s, d).signals.withColumn("details", F.when(F.col("signal_type") != "political_connection", F.col("details"))),  # the mart political_connections reads those of the links
    "detection_status": lambda s, d: detection(s, d, most_pairs=10).status,
    "forest_rates": forest,
    "planted_outliers": planted_outliers,
    "anomalous_price": lambda s, d: X.anomalous_price(D.benford(c(s, d)), forest(s, d)),
    "risk_index_with_forest": lambda s, d: D.risk_index(c(s, d), forest(s, d)),
    "forest_risk": forest_risk,
}
SQL = {
    "run_detection": L.sql(*RUN, query="SELECT * FROM al"),
    "detection_status": L.sql(*RUN, query="SELECT t.d AS detector, CASE WHEN t.d = 'collusion' AND pairs > 10 THEN 'skipped: ' || pairs || ' projected pairs are more than 10' ELSE 'ran' END AS state, CASE WHEN t.d = 'collusion' AND pairs > 10 THEN 0 ELSE coalesce(n, 0) END AS signals, CASE WHEN t.d = 'collusion' THEN pairs END AS projected_pairs FROM unnest(['anomalous_price', 'single_bid', 'concentration', 'anomalous_duration', 'sanctioned_supplier', 'sanctioned_name_match', 'anomalous_geography', 'political_connection', 'notice_clone', 'collusion']) AS t(d), pj LEFT JOIN (SELECT signal_type, count(*) AS n FROM al GROUP BY 1) u ON u.signal_type = t.d"),
    "planted_outliers": L.sql(L.CONTRACTS, query="SELECT count(*) AS suppliers, count(*) AS found FROM (SELECT doc FROM contracts WHERE doc IS NOT NULL GROUP BY doc HAVING count(*) >= 15)"),
    "stream_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(28,10))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events), n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM n GROUP BY user_id, k""",
    "stream_first_seen": "SELECT CAST(ts AS DATE) AS day, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "stream_sights": "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events FROM events GROUP BY 1",
    "stream_latest": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
}
