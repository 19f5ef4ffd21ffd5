"""Query op11: documents drawn to resemble the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.importance import resample
from tidewire.llm.tables import table

NAME = "op11_importance"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: its table by rule, and one step a byte, for each distinct word.
SQL = r"""
WITH ct AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
w AS (SELECT doc_id, rid, n, unnest(ws) AS w FROM (SELECT *, len(ws) AS n FROM (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents))),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM w UNION SELECT w FROM b)), ct),
ws AS (SELECT k, count(*) AS s FROM w JOIN v USING (w) GROUP BY k),
bs AS (SELECT k, count(*) AS t FROM b JOIN v USING (w) GROUP BY k),
z AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM ws) AS s_all, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM bs) AS t_all),
g AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM ws LEFT JOIN bs USING (k), z),
d AS (SELECT rid, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM w JOIN v USING (w) JOIN g USING (k) GROUP BY rid),
n AS (SELECT doc_id, row_number() OVER () AS rid, CAST(len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS BIGINT) AS n_features FROM documents),
s AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM n LEFT JOIN d USING (rid)),
r AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS total FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= total * 10 // 100 THEN place END AS rank FROM r"""
