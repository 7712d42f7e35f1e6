"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ballkmeans import op12
from .egojoin import op5
from .fertility import op9
from .langid import op8, page_languages
from .licences import op13
from .linededup import op10
from .mixing import op3
from .ngram_join import op7
from .periodic import op11
from .sentencepieces import op2
from .shared import documents
from .sharding import op1
from .tokenfiles import op4
from .warc import op6


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jump_shards": lambda spark, d: op1(documents(spark, d)),
        "op2_merge_dropout": lambda spark, d: op2(documents(spark, d)),
        "op3_source_mix": lambda spark, d: op3(documents(spark, d)),
        "op4_token_segments": lambda spark, d: op4(documents(spark, d)),
        "op5_ego_join": lambda spark, d: op5(documents(spark, d, "embeddings")),
        "op6_warc_pages": lambda spark, d: op6(documents(spark, d, "pages")),
        "op7_jaccard_join": lambda spark, d: op7(documents(spark, d)),
        "op8_language_id": lambda spark, d: op8(documents(spark, d)),
        "op9_fertility_rules": lambda spark, d: op9(documents(spark, d)),
        "op10_line_templates": lambda spark, d: op10(documents(spark, d)),
        "op11_periodic_runs": lambda spark, d: op11(documents(spark, d)),
        "op12_ball_kmeans": lambda spark, d: op12(documents(spark, d, "embeddings")),
        "op13_licence_scan": lambda spark, d: op13(documents(spark, d)),
        "page_languages": lambda spark, d: page_languages(documents(spark, d, "pages"), documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc_pages": OP6,
        "op12_ball_kmeans": _op12(),
    }


OP6 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def _op12() -> str:
    """Plain rounds: every vector against every centroid."""
    near = """
SELECT rid, (nearest).k AS k, (nearest).d AS d FROM (
  SELECT rid, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), k := k)) AS nearest
  FROM v, {centers} GROUP BY rid)"""
    parts = ["""
v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT x, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT 16))"""]
    for n in range(3):
        parts.append(f"""
a{n} AS ({near.format(centers=f'c{n}')}),
m{n} AS (
  SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT k, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT k, unnest(x) AS y, unnest(range(64)) AS i FROM a{n} JOIN v USING (rid)) GROUP BY k, i) GROUP BY k
), c{n + 1} AS (SELECT k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))""")
    parts.append(f"\na3 AS ({near.format(centers='c3')})")
    return "WITH" + ",".join(parts) + """
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (rid) JOIN c3 USING (k)
"""
