"""Writing batches, manifests and metrics so that a rerun replaces only its own run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def _run_folder(path: str, run_id: str) -> str:
    return f"{path}/run_id={run_id}"


def write_batch(df: DataFrame, path: str, run_id: str) -> None:
    """Replace the folder of one run, also by no rows at all; other runs stay untouched."""
    df.drop("run_id").write.mode("overwrite").parquet(_run_folder(path, run_id))


def read_batch(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of a run; an empty batch keeps its columns."""
    return spark.read.parquet(_run_folder(path, run_id)).withColumn("run_id", F.lit(run_id))


def write_manifest(manifest: DataFrame, path: str, run_id: str) -> None:
    manifest.drop("run_id").write.mode("overwrite").json(_run_folder(path, run_id))


def write_metrics(metrics: DataFrame, path: str, run_id: str, config_hash: str) -> None:
    """Write a run's metrics; a run id that exists under another configuration is refused."""
    spark = metrics.sparkSession
    try:
        existing = read_batch(spark, path, run_id)
        clash = existing.where(F.col("config_hash") != config_hash).limit(1).count()
    except AnalysisException:
        clash = 0
    if clash:
        raise ValueError("metrics of this run belong to another configuration")
    write_batch(metrics.withColumn("config_hash", F.lit(config_hash)), path, run_id)


def content_addressed(images: DataFrame, suffix: str = ".png") -> DataFrame:
    """One row per distinct image with the published path derived from its bytes."""
    keyed = images.withColumn("digest", F.sha2("content", 256))
    published = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    return published.withColumn(
        "published_path", F.concat(F.lit("assets/evidence/"), "digest", F.lit(suffix))
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Rendered pages as text, one folder per ``page`` so that writers work in parallel."""
    pages.select("page", "html").write.mode("overwrite").partitionBy("page").text(path)
