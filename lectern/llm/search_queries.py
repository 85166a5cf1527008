"""The search of all documents for all benchmark items, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import lexical_search


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


OP11_SQL = r"""
WITH said AS (
  SELECT d, doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
sizes AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM said GROUP BY d),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT i, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
  GROUP BY ALL),
held AS (SELECT d, term, count(*) AS tf FROM said SEMI JOIN wanted USING (term) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, corpus GROUP BY term),
scores AS (
  SELECT i, item_id, doc_id, d,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (d), corpus
  GROUP BY i, item_id, doc_id, d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

PLANS = {"op11_lexical_search": (op11_lexical_search, OP11_SQL)}
