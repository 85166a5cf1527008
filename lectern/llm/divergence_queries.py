"""The audit of sources as a query, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import divergence


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
said AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
totals AS (SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM totals GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS count FROM said SEMI JOIN totals USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, t.term, coalesce(c.count, 0)::HUGEINT AS count, t.total::HUGEINT AS total,
         sum(coalesce(c.count, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS n
  FROM groups g JOIN totals t USING (lang) LEFT JOIN counts c USING (lang, source, term)),
valued AS (
  SELECT lang, source, term, count, (1 + (1000000000 * (count + 2)) // (n + 2 * v))::BIGINT AS p,
         (1 + (1000000000 * (total + 2)) // (lang_n + 2 * v))::BIGINT AS q
  FROM cells JOIN vocabulary USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM valued a JOIN valued b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM valued WHERE count > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

PLANS = {"op12_divergence_audit": (op12_divergence_audit, OP12_SQL)}
