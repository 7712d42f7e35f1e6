"""Queries of the detectors and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import rounded_sql as R
from ..operators import detectors as D
from ..operators import marts as M
from . import lens as L
from .marts import c

political = lambda s, d: D.political_links(c(s, d), L.latest(L.donations(s, d)), L.latest(L.candidacies(s, d)), least_share=0.0005, first="1993-01-01", last="1996-12-31")


def connections(s, d):
    found = political(s, d).select(F.lit("supplier").alias("entity_type"), F.col("doc").alias("entity_id"), F.lit("political_connection").alias("signal_type"), "score", "details")
    gold = found.withColumn("dt", F.lit("2024-01-01")).unionByName(found.withColumn("dt", F.lit("2024-02-01")))
    return M.political_connections(gold, L.candidacies(s, d), L.crosswalk(s, d), L.donations(s, d))


QUERIES = {
    "benford_deviation": lambda s, d: D.benford(c(s, d)),
    "non_competitive_rate": lambda s, d: D.non_competitive_rate(c(s, d)),
    "buyer_concentration": lambda s, d: D.hhi(c(s, d)),
    "duration_outliers_iqr": lambda s, d: D.duration_outliers(c(s, d)).where("outlier"),
    "duration_outliers_zscore": lambda s, d: D.duration_outliers(c(s, d), "zscore").where("outlier"),
    "duration_outlier_share": lambda s, d: D.duration_share(c(s, d)),
    "fraud_signals": lambda s, d: D.fraud_signals(c(s, d)),
    "sanctioned_suppliers": lambda s, d: D.sanctioned_suppliers(c(s, d), L.sanctions(s, d)),
    "anomalous_geography": lambda s, d: D.anomalous_geography(c(s, d), L.establishments(s, d), L.municipalities(s, d)),
    "political_links": lambda s, d: political(s, d).drop("details"),
    "political_connections": connections,
    "dq_political_gates": lambda s, d: M.gates_broken(connections(s, d)).select("signal_id", "share", "score"),
    "dq_political_unmasked": lambda s, d: M.unmasked(connections(s, d).withColumn("donor_document_masked", F.translate("donor_document_masked", "*", "0"))).select("signal_id", "donor_document_masked"),
    "collusion_eligibility": lambda s, d: D.eligibility(c(s, d)),
    "collusion_projection": lambda s, d: D.projected_pairs(D.eligibility(c(s, d), 2)),
    "collusion_pairs": lambda s, d: D.collusion_pairs(D.eligibility(c(s, d), 2)),
    "collusion_ranked": lambda s, d: D.ranked(D.collusion_pairs(D.eligibility(c(s, d), 2))),
    "collusion_signals": lambda s, d: D.collusion_signals(D.ranked(D.collusion_pairs(D.eligibility(c(s, d), 2)))),
    "collusion_calibration": lambda s, d: D.calibration(c(s, d)),
    "collusion_candidate": lambda s, d: D.first_candidate(D.calibration(c(s, d)), 8000),
    "collusion_histogram": lambda s, d: D.wins_histogram(c(s, d), 4),
    "collusion_increment": lambda s, d: D.daily_increment(c(s, d), 365),
    "single_bid_rate": lambda s, d: D.single_bid_rate(c(s, d).select("siafi", (F.length("process_number") % 3).alias("participants")), "siafi"),
    "risk_index": lambda s, d: D.risk_index(c(s, d)),
    "municipal_ranking": lambda s, d: D.municipal_ranking(c(s, d)),
}
q = lambda query, *parts: L.sql(L.CONTRACTS, *parts, query=query)
digit = lambda i: f"count(*) FILTER (WHERE dg = {i})"
chi = " + ".join(f"pow(c{i} - n * log10(1 + 1.0 / {i}::DOUBLE), 2) / (n * log10(1 + 1.0 / {i}::DOUBLE))" for i in range(1, 10))


def benford(source: str = "contracts") -> str:
    return f"""dg AS (SELECT doc, CAST(floor(CAST(amount AS DOUBLE) / pow(10.0, floor(log10(CAST(amount AS DOUBLE))))) AS INTEGER) AS dg FROM {source} WHERE doc IS NOT NULL AND amount > 0),
cn AS (SELECT doc, count(*) AS n, {", ".join(f"{digit(i)} AS c{i}" for i in range(1, 10))} FROM dg GROUP BY doc HAVING count(*) >= 10),
ch AS (SELECT doc, n, {chi} AS x FROM cn),
bf AS (SELECT *, {R("1 - p_value")} AS deviation FROM (SELECT doc, n, {R("x", 6)} AS chi_square, {R("exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6)")} AS p_value FROM ch))"""


NC = "CASE WHEN modality LIKE '%dispensa%' OR modality LIKE '%inexigibilidade%' THEN 1 ELSE 0 END"
RATE = f"rt AS (SELECT doc, count(*) AS contracts, {R(f'CAST(sum({NC}) AS DOUBLE) / count(*)')} AS rate FROM contracts WHERE doc IS NOT NULL GROUP BY doc)"
HHI = f"""bs AS (SELECT siafi, doc, CAST(sum(amount) AS DOUBLE) AS s FROM contracts WHERE doc IS NOT NULL GROUP BY siafi, doc),
bh AS (SELECT siafi, {R("sum(pow(s / t, 2))")} AS hhi, count(*) AS suppliers FROM (SELECT *, sum(s) OVER (PARTITION BY siafi) AS t FROM bs) GROUP BY siafi),
hh AS (SELECT b.siafi, b.contracts, coalesce(hhi, 0.0) AS hhi, coalesce(suppliers, 0) AS suppliers FROM (SELECT siafi, count(*) AS contracts FROM contracts GROUP BY siafi) b LEFT JOIN bh ON b.siafi = bh.siafi)"""
DUR = "du AS (SELECT id, doc, date_diff('day', validity_start, validity_end) AS duration FROM contracts)"
IQR = """qt AS (SELECT quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3 FROM du),
oi AS (SELECT id, doc, duration, coalesce(duration < q1 - 1.5 * (q3 - q1) OR duration > q3 + 1.5 * (q3 - q1), false) AS outlier FROM du, qt)"""
SHARE = f"""sq AS (SELECT doc, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3, count(*) AS n FROM du WHERE doc IS NOT NULL AND duration IS NOT NULL GROUP BY doc HAVING count(*) >= 4),
sh AS (SELECT du.doc, max(n) AS n, {R("avg(CASE WHEN duration < q1 - 1.5 * (q3 - q1) OR duration > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END)")} AS share FROM du JOIN sq ON du.doc = sq.doc WHERE duration IS NOT NULL GROUP BY du.doc)"""
km = "2 * 6371.0 * asin(sqrt(pow(sin(radians(b.latitude - h.latitude) / 2), 2) + cos(radians(h.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - h.longitude) / 2), 2)))"
GEO = f"""home AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cnpj, latitude, longitude FROM supplier JOIN municipalities ON lpad(CAST(s_nationkey AS VARCHAR), 7, '0') = ibge_code WHERE s_suppkey % 10 <> 9),
sm AS (SELECT cnpj, city, uf, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount FROM contracts WHERE cnpj IS NOT NULL GROUP BY cnpj, city, uf),
gg AS (SELECT sm.cnpj, ibge_code, contracts, total_amount, {km} AS km FROM sm JOIN municipalities b ON sm.city = b.name AND sm.uf = b.uf JOIN home h ON h.cnpj = sm.cnpj)"""
POL = f"""sg AS (SELECT * FROM contracts WHERE signature_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'),
tw AS (SELECT city, CAST(sum(amount) AS DOUBLE) AS town FROM sg GROUP BY city),
ow AS (SELECT city, uf, doc, CAST(sum(amount) AS DOUBLE) AS own, count(*) AS contracts FROM sg WHERE doc IS NOT NULL GROUP BY city, uf, doc),
gv AS (SELECT CASE WHEN s_suppkey % 10 <> 9 THEN lpad(CAST(s_suppkey AS VARCHAR), 14, '0') ELSE lpad(CAST(s_suppkey AS VARCHAR), 11, '0') END AS doc, CAST((s_suppkey % 9) * 400 AS DOUBLE) AS donated, s_nationkey, DATE '1992-08-01' + CAST(s_suppkey % 60 AS INTEGER) AS given_on, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 < 2 AND s_nationkey % 6 <> 0),
tb AS (SELECT city, min_by(agency, id) AS buyer_name, min_by(siafi, id) AS buyer_siafi, min_by(city, id) AS buyer_city FROM sg GROUP BY city),
pl AS (SELECT replace(upper(ow.city), '_', ' ') AS city, uf, ow.doc, CAST(s_nationkey AS VARCHAR) AS candidate_sequential, 1992 AS election_year, donated, contracts, {R("own / town")} AS share, {R("least(1.0, own / town / 0.25)")} AS score, own, town, s_nationkey AS k, given_on, buyer_name, buyer_siafi, n_name
  FROM ow JOIN tw ON ow.city = tw.city JOIN tb ON tb.city = ow.city JOIN gv ON gv.doc = ow.doc AND upper(n_name) = upper(ow.city) WHERE donated >= 1000 AND own / town >= 0.0005),
pc AS (SELECT upper(sha256(election_year || '|' || candidate_sequential || '|' || doc)) AS signal_id, '2024-02-01' AS signal_dt, election_year, CASE WHEN length(doc) = 11 THEN '***' || substr(doc, 4, 6) || '**' ELSE doc END AS donor_document_masked, CASE WHEN length(doc) = 11 THEN 'PF' ELSE 'PJ' END AS donor_document_type,
  'Candidate ' || k AS candidate_name, 'P' || (k % 3) AS party, 'Prefeito' AS office, lpad(CAST(k AS VARCHAR), 5, '0') AS ue_code, {{initcap}} AS municipality, uf, CASE WHEN k % 3 <> 0 THEN 'SI' || k ELSE buyer_siafi END AS siafi_code, CASE WHEN k % 3 <> 0 THEN lpad(CAST(k AS VARCHAR), 7, '0') END AS ibge_code, buyer_name, contracts,
  CAST(1 AS BIGINT) AS donations, given_on AS first_donation, given_on AS last_donation, donated AS donation_total_brl, {R("own", 2)} AS contracts_total_brl, {R("town", 2)} AS buyer_total_brl, share, score, DATE '1993-01-01' AS mandate_start, DATE '1996-12-31' AS mandate_end FROM pl)"""
POL = POL.replace("{initcap}", "array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
ELIG = "SELECT siafi AS buyer, cnpj AS supplier, count(*) AS wins FROM contracts WHERE cnpj IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= "
PAIRS = f"""el AS ({ELIG}2), pr AS (SELECT x.supplier AS s1, y.supplier AS s2, count(*) AS buyer_count, sum(x.wins + y.wins) AS wins_sum, string_agg(x.buyer, ',' ORDER BY x.buyer) AS buyers FROM el x JOIN el y ON x.buyer = y.buyer AND x.supplier < y.supplier GROUP BY 1, 2 HAVING count(*) >= 2)"""
PROJECT = "SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM {e} GROUP BY buyer)"
GRID = " UNION ALL ".join(f"SELECT {w} AS min_wins, {b} AS min_buyers, (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM el WHERE wins >= {w} AND supplier IN (SELECT supplier FROM el WHERE wins >= {w} GROUP BY supplier HAVING count(*) >= {b}) GROUP BY buyer)) AS pairs" for w in (2, 3, 4) for b in (2, 3))
gates = [("rate >= 0.5", "rate", 0.35), ("hhi >= 0.25", "hhi", 0.35), ("p_value < 0.05", "deviation", 0.15), ("share >= 0.2", "share", 0.15)]
VALUE, WEIGHT = (" + ".join(f"CASE WHEN {g} THEN {y} ELSE 0.0::DOUBLE END" for g, y in z) for z in ([(g, f"{x} * {w}::DOUBLE") for g, x, w in gates], [(g, f"{w}::DOUBLE") for g, x, w in gates]))
RISK = f"""us AS (SELECT * REPLACE (coalesce(doc, 'unknown') AS doc) FROM contracts),
ur AS (SELECT doc, count(*) AS contracts, {R(f'CAST(sum({NC}) AS DOUBLE) / count(*)')} AS rate FROM us GROUP BY doc),
ub AS (SELECT siafi, doc, CAST(sum(amount) AS DOUBLE) AS s FROM us GROUP BY siafi, doc),
uq AS (SELECT siafi, doc, sum(pow(s / t, 2)) OVER (PARTITION BY siafi) AS h FROM (SELECT *, sum(s) OVER (PARTITION BY siafi) AS t FROM ub)),
uh AS (SELECT doc, {R("max(h)")} AS hhi FROM uq GROUP BY doc), du AS (SELECT id, doc, date_diff('day', validity_start, validity_end) AS duration FROM us), {SHARE}, {benford("us")},
ri AS (SELECT ur.doc, contracts, {R(f"coalesce(({VALUE}) / nullif({WEIGHT}, 0), 0.0)")} AS risk FROM ur LEFT JOIN uh ON ur.doc = uh.doc LEFT JOIN bf ON ur.doc = bf.doc LEFT JOIN sh ON ur.doc = sh.doc)"""
SQL = {
    "benford_deviation": q("SELECT doc, n, chi_square, p_value, deviation FROM bf", benford()),
    "non_competitive_rate": q("SELECT * FROM rt", RATE),
    "buyer_concentration": q("SELECT * FROM hh", HHI),
    "duration_outliers_iqr": q("SELECT * FROM oi WHERE outlier", DUR, IQR),
    "duration_outliers_zscore": q("SELECT id, doc, duration, true AS outlier FROM du, (SELECT avg(duration) AS m, stddev_pop(duration) AS sd FROM du) WHERE abs(duration - m) > 3 * sd", DUR),
    "duration_outlier_share": q("SELECT * FROM sh", DUR, SHARE),
    "fraud_signals": q(f"""SELECT 'supplier' AS entity_type, doc AS entity_id, 'anomalous_price' AS signal_type, deviation AS score FROM bf UNION ALL SELECT 'supplier', doc, 'single_bid', rate FROM rt WHERE rate > 0 AND contracts >= 3
      UNION ALL SELECT 'buyer', siafi, 'concentration', hhi FROM hh WHERE contracts >= 3 UNION ALL SELECT * FROM (SELECT 'supplier', doc, 'anomalous_duration', {R("avg(CASE WHEN outlier THEN 1.0 ELSE 0.0 END)")} AS sc FROM oi WHERE doc IS NOT NULL AND duration IS NOT NULL GROUP BY doc HAVING count(*) >= 3) WHERE sc > 0""", benford(), RATE, HHI, DUR, IQR),
    "sanctioned_suppliers": q("SELECT c.doc, string_agg(DISTINCT s.id, ',' ORDER BY s.id) AS sanctions, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, count(DISTINCT c.id) AS contracts, 1.0::DOUBLE AS score FROM contracts c JOIN sanctions s ON c.doc = s.doc AND signature_date BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31') GROUP BY c.doc", L.SANCTIONS),
    "anomalous_geography": q(f"SELECT cnpj, ibge_code, contracts, total_amount, {R('km', 6)} AS distance_km, {R('least(1.0, km / 1000)')} AS score FROM gg WHERE km > 100", L.MUNICIPALITIES, GEO),
    "political_links": q("SELECT city, uf, doc, candidate_sequential, election_year, donated, contracts, share, score FROM pl", POL),
    "political_connections": q("SELECT * FROM pc", POL),
    "dq_political_gates": q("SELECT signal_id, share, score FROM pc WHERE share < 0.05", POL),
    "dq_political_unmasked": q("SELECT signal_id, replace(donor_document_masked, '*', '0') AS donor_document_masked FROM pc WHERE donor_document_type = 'PF'", POL),
    "collusion_eligibility": q(f"{ELIG}3"),
    "collusion_projection": q(f"SELECT 'unblocked' AS kind, CAST(({PROJECT.format(e='el')}) AS BIGINT) AS pairs UNION ALL SELECT 'blocked', CAST(({PROJECT.format(e='bl')}) AS BIGINT)", f"el AS ({ELIG}2)", "bl AS (SELECT * FROM el WHERE supplier IN (SELECT supplier FROM el GROUP BY supplier HAVING count(DISTINCT buyer) >= 2))"),
    "collusion_pairs": q("SELECT s1, s2, buyer_count, CAST(wins_sum AS BIGINT) AS wins_sum, buyers FROM pr", PAIRS),
    "collusion_ranked": q(f"SELECT s1, s2, buyer_count, CAST(wins_sum AS BIGINT) AS wins_sum, buyers, (SELECT {R('least(1.0::DOUBLE, 500.0::DOUBLE / greatest(count(*), 1))')} FROM pr) AS coverage FROM pr ORDER BY buyer_count DESC, wins_sum DESC, s1, s2 LIMIT 500", PAIRS),
    "collusion_signals": q("SELECT 'supplier_pair' AS entity_type, s1 || '+' || s2 AS entity_id, 'collusion' AS signal_type, 1.0::DOUBLE AS score, buyers, CAST(wins_sum AS BIGINT) AS wins_sum FROM pr ORDER BY buyer_count DESC, wins_sum DESC, s1, s2 LIMIT 500", PAIRS),
    "collusion_candidate": q(f"SELECT * FROM ({GRID}) WHERE pairs <= 8000 ORDER BY min_wins, min_buyers LIMIT 1", f"el AS ({ELIG}2)"),
    "collusion_histogram": q("SELECT least(wins, 4) AS wins, count(*) AS pairs FROM (SELECT count(*) AS wins FROM contracts WHERE cnpj IS NOT NULL GROUP BY siafi, cnpj) GROUP BY 1"),
    "collusion_increment": q(f"SELECT all_pairs, older_pairs, {R('(all_pairs - older_pairs) / 365.0')} AS a_day FROM (SELECT (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM el WHERE supplier IN (SELECT supplier FROM el GROUP BY supplier HAVING count(*) >= 2) GROUP BY buyer)) AS all_pairs, (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM eo WHERE supplier IN (SELECT supplier FROM eo GROUP BY supplier HAVING count(*) >= 2) GROUP BY buyer)) AS older_pairs)",
                             f"el AS ({ELIG}2)", "eo AS (SELECT siafi AS buyer, cnpj AS supplier, count(*) AS wins FROM contracts WHERE cnpj IS NOT NULL AND signature_date <= (SELECT max(signature_date) FROM contracts) - 365 GROUP BY 1, 2 HAVING count(*) >= 2)"),
    "single_bid_rate": q(f"SELECT siafi, count(*) AS biddings, {R('avg(CASE WHEN length(process_number) % 3 = 1 THEN 1.0 ELSE 0.0 END)')} AS rate FROM contracts GROUP BY siafi"),
    "collusion_calibration": q(GRID, f"el AS ({ELIG}2)"),
    "risk_index": q("SELECT doc, contracts, risk, risk >= 0.7 AS alert FROM ri", RISK),
    "municipal_ranking": q(f"""SELECT city, uf, contracts, hhi, rate, {R("least(hhi * 0.5 + rate * 0.5, 1.0::DOUBLE)")} AS risk FROM (SELECT city, uf, CAST(sum(n) AS BIGINT) AS contracts, {R("sum(pow(s / t, 2))")} AS hhi, {R("CAST(sum(k) AS DOUBLE) / sum(n)")} AS rate FROM (SELECT *, sum(s) OVER (PARTITION BY city, uf) AS t FROM (SELECT city, uf, cnpj, CAST(sum(amount) AS DOUBLE) AS s, count(*) AS n, sum({NC}) AS k FROM contracts GROUP BY 1, 2, 3)) GROUP BY 1, 2) ORDER BY 6 DESC, 1, 2 LIMIT 50"""),
}
