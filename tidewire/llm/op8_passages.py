"""Query op8: documents without passages that an earlier document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.passages import drop_repeated_passages
from tidewire.llm.tables import table

NAME = "op8_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


PASSAGES_SQL = """
pw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
pi AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM pw),
pn AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM pi),
pf AS (SELECT win, min(doc_id) AS first_id FROM pn GROUP BY win HAVING count(*) > 1),
pb AS (SELECT pn.doc_id, pn.i FROM pn JOIN pf ON pn.win = pf.win AND pf.first_id < pn.doc_id),
pc AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM pb),
pd AS (SELECT doc_id, list(p) AS gone FROM pc GROUP BY doc_id),
pq AS (SELECT pw.doc_id, ws, coalesce(gone, []) AS gone FROM pw LEFT JOIN pd ON pw.doc_id = pd.doc_id),
passages AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
    CASE WHEN len(gone) = 0 THEN array_to_string(ws, ' ')
         ELSE array_to_string(list_filter(ws, lambda w, i: NOT list_contains(gone, i)), ' ') END AS kept FROM pq)"""

SQL = f"WITH {PASSAGES_SQL.format(docs='documents').strip()} SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM passages"
