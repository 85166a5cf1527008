"""The operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import chat_queries, divergence_queries, exact_dedup, fingerprints, jaccard_join, mixing, mixing_lm, packing, pii, rlz, search_queries, suffix_dedup, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_texts(documents(spark, sf_dir))


def op7_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_passages(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


#: Name: (query, SQL or None).
PLANS = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_pii": (op2_pii, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_ngram_jaccard": (op4_ngram_jaccard, None),
    "op5_suffix_array": (op5_suffix_array, None),
    "op6_context_mixing": (op6_context_mixing, None),
    "op7_relative_lempel_ziv": (op7_relative_lempel_ziv, None),
    "op8_packing": (op8_packing, None),
    "op9_fingerprints": (op9_fingerprints, None),
    "op10_mixing": (op10_mixing, None),
    **search_queries.PLANS,
    **divergence_queries.PLANS,
    **chat_queries.PLANS,
}
