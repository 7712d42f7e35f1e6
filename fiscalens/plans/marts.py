"""Queries over the marts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts as M
from ..functions.rounding import rounded_sql as R
from ..functions.storage import stored
from . import lens as L

c = lambda s, d: L.flat(L.contracts(s, d))
flags = lambda s, d: stored(s, d, "red-flags", lambda: M.red_flags(c(s, d), L.raw_payloads(s, d)))
amends = lambda s, d: stored(s, d, "amendments", lambda: M.amendments(c(s, d), L.raw_payloads(s, d), L.raw_payloads(s, d, updates=True)))
usage = lambda s, d: M.pod_usage_hourly(L.pod_snapshots(s, d))
cost = lambda s, d: M.platform_cost_daily(usage(s, d), L.requests(s))


def spoiled_flags(s, d):
    """The mart with faults planted, for its tests to find: rows twice, flags of 2, an index above 1."""
    bad = F.col("id").endswith("7")
    f = flags(s, d)
    return f.unionByName(f.where(bad)).withColumns({"f_short_window": F.when(bad, 2).otherwise(F.col("f_short_window")), "cri": F.when(F.col("id").endswith("17"), 1.5).otherwise(F.col("cri"))})


def spoiled_amendments(s, d):
    bad = F.col("id").endswith("7")
    return amends(s, d).where(~F.col("id").endswith("3")).withColumns({"ratio": F.when(bad, -1.0).otherwise(F.col("ratio")), "f_value": F.when(F.col("id").endswith("1") | F.col("siafi").endswith("1"), F.col("f_value"))})


twice = lambda df: df.unionByName(df.where("pod like '%-3'"))


QUERIES = {
    "contracts_daily": lambda s, d: M.contracts_daily(c(s, d)),
    "contracts_by_agency": lambda s, d: M.contracts_by_agency(c(s, d)),
    "supplier_stats": lambda s, d: M.supplier_stats(c(s, d)),
    "data_quality_daily": lambda s, d: M.data_quality_daily(c(s, d)),
    "serving_municipality_daily": lambda s, d: M.municipality_daily(c(s, d)),
    "serving_supplier_stats": lambda s, d: M.supplier_stats(c(s, d)).select("*"),
    "contract_red_flags": lambda s, d: M.red_flags(c(s, d), L.raw_payloads(s, d)),
    "red_flags_by_agency": lambda s, d: M.red_flags_by(flags(s, d), "siafi"),
    "red_flags_by_supplier": lambda s, d: M.red_flags_by(flags(s, d), "doc"),
    "contract_amendments": lambda s, d: M.amendments(c(s, d), L.raw_payloads(s, d), L.raw_payloads(s, d, updates=True)),
    "amendments_by_agency": lambda s, d: M.amendments_by(amends(s, d), "siafi"),
    "amendments_by_supplier": lambda s, d: M.amendments_by(amends(s, d), "doc"),
    "contract_term_flags": lambda s, d: M.term_flags(L.contract_terms(s, d)),
    "pod_usage_hourly": usage,
    "platform_cost_daily": cost,
    "dq_red_flags_unique": lambda s, d: M.duplicates(spoiled_flags(s, d), "id"),
    "dq_red_flags_domain": lambda s, d: M.out_of_domain(spoiled_flags(s, d), M.FLAGS, "not cri between 0 and 1"),
    "dq_red_flags_cardinality": lambda s, d: M.cardinality(spoiled_flags(s, d), c(s, d)),
    "dq_red_flags_unmatched": lambda s, d: M.unmatched(flags(s, d)),
    "dq_amendments_cardinality": lambda s, d: M.cardinality(spoiled_amendments(s, d), c(s, d)),
    "dq_amendments_domain": lambda s, d: M.out_of_domain(spoiled_amendments(s, d), ["f_value", "f_term"], "ratio <= 0"),
    "dq_amendments_viability": lambda s, d: M.not_viable(spoiled_amendments(s, d)),
    "dq_pod_hours_unique": lambda s, d: M.duplicates(twice(usage(s, d)), "hour", "pod"),
    "dq_pod_days_unique": lambda s, d: M.duplicates(cost(s, d), "dt", "pod"),
    "dq_flag_viability": lambda s, d: M.viability(flags(s, d)),
    "dq_item_key_duplicates": lambda s, d: M.duplicates(L.table(s, d, "lineitem"), "l_orderkey", "l_linenumber"),
    "portal_kpis": lambda s, d: M.portal_kpis(c(s, d), flags(s, d), M.data_quality_daily(c(s, d)), cost(s, d)),
    "panel_step_durations": lambda s, d: M.step_durations(L.step_metrics(s, d)),
    "panel_rows_by_pipeline": lambda s, d: M.rows_by_pipeline(L.step_metrics(s, d)),
    "panel_failing_steps": lambda s, d: M.failing_steps(L.step_metrics(s, d)),
    "panel_costs": lambda s, d: M.cost_listing(cost(s, d)),
    "panel_usage": lambda s, d: M.usage_listing(usage(s, d)),
    "panel_idle_by_component": lambda s, d: M.idle_by_component(cost(s, d)),
}

FLAGS = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM items WHERE NOT is_update) WHERE rn = 1),
f AS (SELECT c.id, c.dt, c.siafi, c.doc, c.modality, l.id IS NOT NULL AS bronze_matched, CASE WHEN modality IN ('', 'not_informed') OR modality IS NULL THEN NULL WHEN modality LIKE '%dispensa%' OR modality LIKE '%inexigibilidade%' THEN 1 ELSE 0 END AS f_non_competitive,
  CASE WHEN closed IS NULL THEN NULL WHEN date_diff('day', opened, closed) < 7 THEN 1 ELSE 0 END AS f_short_window, CASE WHEN initial > 0 AND final > 0 THEN CASE WHEN final > initial THEN 1 ELSE 0 END END AS f_price_ratio
  FROM contracts c LEFT JOIN latest l ON c.id = l.id),
flags AS (SELECT *, {R('CAST(coalesce(f_non_competitive, 0) + coalesce(f_short_window, 0) + coalesce(f_price_ratio, 0) AS DOUBLE) / nullif(CAST(f_non_competitive IS NOT NULL AS INTEGER) + CAST(f_short_window IS NOT NULL AS INTEGER) + CAST(f_price_ratio IS NOT NULL AS INTEGER), 0)')} AS cri FROM f)"""
SPOILED = """spoiled AS (SELECT * REPLACE (CASE WHEN id LIKE '%7' THEN 2 ELSE f_short_window END AS f_short_window, CASE WHEN id LIKE '%17' THEN 1.5 ELSE cri END AS cri) FROM (SELECT * FROM flags UNION ALL SELECT * FROM flags WHERE id LIKE '%7'))"""
AMENDS = """a AS (SELECT id, min_by(initial, seq) FILTER (WHERE initial > 0) AS initial, max_by(final, seq) FILTER (WHERE final > 0) AS final, min_by(ends, seq) AS first_end, max_by(ends, seq) AS last_end, max(rectifications) AS rectifications, count(*) AS n FROM items GROUP BY id),
amends AS (SELECT c.id, c.dt, c.siafi, c.doc, n IS NOT NULL AS matched, coalesce(n, 0) AS observations, CAST(final > initial AS INTEGER) AS f_value, CAST(last_end > first_end AS INTEGER) AS f_term, rectifications, CAST(final AS DOUBLE) / CAST(initial AS DOUBLE) AS ratio FROM contracts c LEFT JOIN a ON a.id = c.id)"""
BAD_AMENDS = """bad AS (SELECT * REPLACE (CASE WHEN id LIKE '%7' THEN -1.0 ELSE ratio END AS ratio, CASE WHEN id LIKE '%1' OR siafi LIKE '%1' THEN f_value END AS f_value) FROM amends WHERE id NOT LIKE '%3')"""
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
USAGE = f"""samples AS (SELECT date_trunc('hour', ts) AS hour, event_type || '-' || (user_id % 20) AS pod, {K} AS cpu, {K} * 1048576 + user_id % 7 AS memory FROM events WHERE user_id % 50 <> 0),
hourly AS (SELECT hour, pod, {R("avg(cpu)", 6)} AS avg_cpu, max(cpu) AS max_cpu, {R("avg(memory)", 6)} AS avg_memory, max(memory) AS max_memory, count(*) AS samples FROM samples GROUP BY 1, 2)"""
COST = f"""requests(component, pod_pattern, request_cpu, request_memory) AS (VALUES ('viewer', 'view-%', 50.0::DOUBLE, 64e6::DOUBLE), ('shop', 'purchase-%', 80.0, 48e6), ('first', '%-1', 40.0, 0.0), ('errors', 'error-%', 0.0, 32e6)),
daily AS (SELECT CAST(hour AS DATE) AS dt, pod, {R('avg(avg_cpu)')} AS avg_cpu, max(max_cpu) AS max_cpu, {R('avg(avg_memory)')} AS avg_memory, max(max_memory) AS max_memory FROM hourly GROUP BY 1, 2),
cost AS (SELECT dt, pod, component, avg_cpu, request_cpu, max_cpu, avg_memory, request_memory, max_memory, {R('1 - avg_cpu / nullif(request_cpu, 0)')} AS cpu_idle, {R('1 - avg_memory / nullif(request_memory, 0)')} AS memory_idle FROM daily LEFT JOIN requests ON pod LIKE pod_pattern)"""
BY_FLAGS = f"SELECT {{k}}, count(*) AS contracts, count(cri) AS scored, {R('avg(cri)')} AS mean_cri, {R('avg(f_non_competitive)')} AS share_non_competitive, {R('avg(f_short_window)')} AS share_short_window, {R('avg(f_price_ratio)')} AS share_price_ratio FROM flags WHERE {{k}} IS NOT NULL GROUP BY {{k}}"
BY_AMENDS = f"SELECT {{k}}, count(*) AS contracts, count(*) FILTER (WHERE matched) AS matched, {R('avg(f_value)')} AS share_value, {R('avg(f_term)')} AS share_term, {R('avg(ratio)')} AS mean_ratio, max(rectifications) AS most_rectifications FROM amends WHERE {{k}} IS NOT NULL GROUP BY {{k}}"
q = lambda query, *parts: L.sql(L.CONTRACTS, *parts, query=query)
SQL = {
    "contracts_daily": q("SELECT dt, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount, count(DISTINCT siafi) AS agencies, count(DISTINCT doc) AS suppliers FROM contracts GROUP BY dt"),
    "contracts_by_agency": q("SELECT v.siafi, agency, level, uf, contracts, total_amount, first_date, last_date FROM (SELECT siafi, agency, row_number() OVER (PARTITION BY siafi ORDER BY count(*) DESC, agency DESC) AS r FROM contracts GROUP BY siafi, agency) v JOIN (SELECT siafi, max(level) AS level, max(uf) AS uf, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount, min(signature_date) AS first_date, max(signature_date) AS last_date FROM contracts GROUP BY siafi) t ON v.siafi = t.siafi WHERE r = 1"),
    "supplier_stats": q("SELECT doc, min(legal_name) AS legal_name, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount, count(DISTINCT siafi) AS agencies, min(dt) AS first_dt, max(dt) AS last_dt FROM contracts WHERE doc IS NOT NULL GROUP BY doc"),
    "data_quality_daily": q("SELECT dt, count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (WHERE coalesce(amount, 0) = 0) AS zero_amounts, count(*) FILTER (WHERE doc IS NULL) AS no_supplier, count(*) - count(DISTINCT id) AS duplicates FROM contracts GROUP BY dt"),
    "serving_municipality_daily": q("SELECT dt, city, uf, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount, count(DISTINCT doc) AS suppliers FROM contracts WHERE city IS NOT NULL GROUP BY dt, city, uf"),
    "contract_red_flags": q("SELECT * FROM flags", L.ITEMS, FLAGS),
    "red_flags_by_agency": q(BY_FLAGS.format(k="siafi"), L.ITEMS, FLAGS),
    "red_flags_by_supplier": q(BY_FLAGS.format(k="doc"), L.ITEMS, FLAGS),
    "contract_amendments": q("SELECT * FROM amends", L.ITEMS, AMENDS),
    "amendments_by_agency": q(BY_AMENDS.format(k="siafi"), L.ITEMS, AMENDS),
    "amendments_by_supplier": q(BY_AMENDS.format(k="doc"), L.ITEMS, AMENDS),
    "contract_term_flags": f"""WITH t AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 <> 0 THEN 'Termo Aditivo' ELSE 'Termo de Apostilamento' END AS kind, l_partkey % 2 = 0 AS raises, l_partkey % 3 = 0 AS extends, CAST(trunc(l_quantity) AS INTEGER) - 25 AS value, CASE WHEN l_linenumber <> 4 THEN CAST(l_suppkey % 30 - 9 AS INTEGER) END AS days FROM lineitem),
      g AS (SELECT k, CAST(coalesce(bool_or(kind = 'Termo Aditivo' AND raises AND value > 0), false) AS INTEGER) AS v, CAST(coalesce(bool_or(kind = 'Termo Aditivo' AND extends AND days > 0), false) AS INTEGER) AS d, count(*) AS n, CAST(sum(value) AS DOUBLE) AS s, coalesce(sum(days), 0) AS sd, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM t GROUP BY k)
      SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE v END AS f_value_terms, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE d END AS f_term_terms, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE n END AS terms_count,
        CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE s END AS value_increase, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 0 ELSE CAST(sd AS BIGINT) END AS days_extended, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN '' ELSE kinds END AS term_types FROM g""",
    "pod_usage_hourly": L.sql(USAGE, query="SELECT * FROM hourly"),
    "platform_cost_daily": L.sql(USAGE, COST, query="SELECT * FROM cost"),
    "dq_red_flags_unique": q("SELECT id, count(*) AS n FROM spoiled GROUP BY id HAVING count(*) > 1", L.ITEMS, FLAGS, SPOILED),
    "dq_red_flags_domain": q("SELECT * FROM spoiled WHERE f_short_window NOT IN (0, 1) OR NOT cri BETWEEN 0 AND 1", L.ITEMS, FLAGS, SPOILED),
    "dq_red_flags_cardinality": q("SELECT * FROM (SELECT (SELECT count(*) FROM spoiled) AS mart_rows, (SELECT count(*) FROM contracts) AS silver_rows) WHERE mart_rows <> silver_rows", L.ITEMS, FLAGS, SPOILED),
    "dq_red_flags_unmatched": q(f"SELECT count(*) FILTER (WHERE NOT bronze_matched) AS unmatched, count(*) AS contracts, {R('CAST(count(*) FILTER (WHERE NOT bronze_matched) AS DOUBLE) / count(*)')} AS share FROM flags HAVING count(*) FILTER (WHERE NOT bronze_matched) >= 0.01 * count(*)", L.ITEMS, FLAGS),
    "dq_amendments_cardinality": q("SELECT * FROM (SELECT (SELECT count(*) FROM bad) AS mart_rows, (SELECT count(*) FROM contracts) AS silver_rows) WHERE mart_rows <> silver_rows", L.ITEMS, AMENDS, BAD_AMENDS),
    "dq_amendments_domain": q("SELECT * FROM bad WHERE ratio <= 0", L.ITEMS, AMENDS, BAD_AMENDS),
    "dq_amendments_viability": q(f"SELECT count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE matched AND f_value IS NOT NULL) AS computable, {R('CAST(count(*) FILTER (WHERE matched AND f_value IS NOT NULL) AS DOUBLE) / count(*) FILTER (WHERE matched)')} AS share FROM bad HAVING count(*) FILTER (WHERE matched AND f_value IS NOT NULL) < 0.5 * count(*) FILTER (WHERE matched)", L.ITEMS, AMENDS, BAD_AMENDS),
    "dq_pod_hours_unique": L.sql(USAGE, query="SELECT hour, pod, CAST(2 AS BIGINT) AS n FROM hourly WHERE pod LIKE '%-3'"),
    "dq_pod_days_unique": L.sql(USAGE, COST, query="SELECT dt, pod, count(*) AS n FROM cost GROUP BY 1, 2 HAVING count(*) > 1"),
    "dq_flag_viability": q("SELECT 'f_non_competitive' AS flag, round(avg(CAST(f_non_competitive IS NOT NULL AS INTEGER)), 4) AS share FROM flags UNION ALL SELECT 'f_short_window', round(avg(CAST(f_short_window IS NOT NULL AS INTEGER)), 4) FROM flags UNION ALL SELECT 'f_price_ratio', round(avg(CAST(f_price_ratio IS NOT NULL AS INTEGER)), 4) FROM flags", L.ITEMS, FLAGS),
    "dq_item_key_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "portal_kpis": q(f"SELECT * FROM (SELECT count(*) AS recent_contracts, CAST(sum(amount) AS DOUBLE) AS recent_amount FROM contracts WHERE signature_date > (SELECT max(signature_date) FROM contracts) - 30), (SELECT count(*) AS contracts, count(*) FILTER (WHERE cri >= 0.5) AS high_cri FROM flags), (SELECT count(*) - count(DISTINCT id) AS duplicate_ids FROM contracts WHERE dt = (SELECT max(dt) FROM contracts)), (SELECT {R('avg(cpu_idle)')} AS mean_idle FROM cost WHERE dt = (SELECT max(dt) FROM cost))", L.ITEMS, FLAGS, USAGE, COST),
    "serving_supplier_stats": q("SELECT doc, min(legal_name) AS legal_name, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_amount, count(DISTINCT siafi) AS agencies, min(dt) AS first_dt, max(dt) AS last_dt FROM contracts WHERE doc IS NOT NULL GROUP BY doc"),
    "panel_step_durations": L.sql(L.METRICS, query=f"SELECT step, count(*) AS runs, {R('avg(seconds)')} AS mean_seconds, max(seconds) AS most_seconds FROM metrics WHERE started_at > (SELECT max(started_at) FROM metrics) - INTERVAL 7 DAY GROUP BY step"),
    "panel_rows_by_pipeline": L.sql(L.METRICS, query="SELECT pipeline, CAST(sum(rows) AS BIGINT) AS rows FROM metrics WHERE starts_with(step, 'crawl_') OR starts_with(step, 'collect_') OR step = 'normalize' GROUP BY pipeline"),
    "panel_failing_steps": L.sql(L.METRICS, query="SELECT pipeline, step, CAST(sum(errors) AS BIGINT) AS errors FROM metrics GROUP BY 1, 2 HAVING sum(errors) > 0"),
    "panel_costs": L.sql(USAGE, COST, query=f"SELECT pod, component, avg_cpu, request_cpu, {R('avg_memory / 1048576', 2)} AS avg_memory_mib, {R('request_memory / 1048576', 2)} AS request_memory_mib, cpu_idle FROM cost WHERE dt = (SELECT max(dt) FROM cost)"),
    "panel_usage": L.sql(USAGE, query=f"SELECT pod, max(max_cpu) AS max_cpu, {R('max(max_memory) / 1048576', 2)} AS max_memory_mib, CAST(sum(samples) AS BIGINT) AS samples FROM hourly WHERE hour > (SELECT max(hour) FROM hourly) - INTERVAL 24 HOUR GROUP BY pod"),
    "panel_idle_by_component": L.sql(USAGE, COST, query=f"SELECT component, {R('avg(cpu_idle)')} AS cpu_idle, {R('avg(memory_idle)')} AS memory_idle FROM cost WHERE component IS NOT NULL GROUP BY component"),
}
