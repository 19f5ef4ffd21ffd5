"""Query op13: clusters of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.kdtrees import clusters
from tidewire.llm.tables import table

NAME = "op13_centroid_clusters"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """SQL for centroids c1 to cn, each from the vectors nearest to those before."""
    return ",\n".join(f"""a{i} AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, vec_id, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q, c{i}) GROUP BY rid, vec_id),
m{i} AS (SELECT k, list(s ORDER BY j) AS c FROM (SELECT k, j, CAST(floor_div AS BIGINT) AS s FROM (SELECT k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
  FROM (SELECT k, unnest(v) AS x, unnest(range({64})) AS j FROM a{i} JOIN q USING (vec_id)) GROUP BY k, j)) GROUP BY k),
c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""" for i in range(n))  # fmt: skip


SQL = f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM q ORDER BY sha256('2:' || vec_id) LIMIT 40),
{_rounds(5)},
f AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, vec_id, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM q, c5) GROUP BY rid, vec_id)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c5 USING (k)"""
