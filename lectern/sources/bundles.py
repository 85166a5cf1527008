"""Feedback bundles as files: bounded, parsed, and held against the digest they carry."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lectern.operators.feedback import LOG_ORDER
from lectern.schemas import BUNDLE
from lectern.sources.files import read_files


def _content_digest(content: bytes) -> str | None:
    """SHA-256 of a JSON object without its ``digest``, keys in order at every depth; None if it is no object."""

    def once(pairs: list[tuple]) -> dict:
        if len({key for key, _ in pairs}) != len(pairs):
            raise ValueError("a key is given twice")
        return dict(pairs)

    try:
        payload = json.loads(content.decode("utf-8"), object_pairs_hook=once)
    except (ValueError, RecursionError):
        return None
    if not isinstance(payload, dict):
        return None
    payload.pop("digest", None)
    canonical = json.dumps(payload, ensure_ascii=True, separators=(",", ":"), sort_keys=True)
    return hashlib.sha256(canonical.encode("ascii")).hexdigest()


@pandas_udf(StringType())
def content_digest(content: pd.Series) -> pd.Series:
    """Canonical digest of each file; null for what is no JSON object in UTF-8 with keys given once."""
    return content.map(lambda c: None if c is None else _content_digest(bytes(c)))


def checked_bundles(files: DataFrame, max_commands: int) -> DataFrame:
    """``path, status, bundle`` for every file of ``files`` (path, content, status as ``read_files`` gives them).

    The first rule a file breaks is its status: too_large, unreadable, incomplete (a field of
    the bundle or of a command is missing or of another type), digest_mismatch,
    too_many_commands, not_ordered or repeated_command; else accepted, and only then
    ``bundle`` is not null.  Order is that of the log; equal places count as ordered.
    """
    # One element to explode keeps the parsed columns from being computed once per use.
    parsed = files.withColumn("_digest", content_digest("content")).withColumn(
        "_b", F.explode(F.array(F.from_json(F.try_validate_utf8(F.col("content").cast("string")), BUNDLE)))
    )
    commands = F.col("_b.commands")
    names = BUNDLE["commands"].dataType.elementType.fieldNames()

    def complete(command):
        wrong = F.lit(False)
        for name in names:
            wrong = wrong | command[name].isNull()
        return ~wrong

    whole = F.col("_b").isNotNull() & F.forall(commands, complete)
    for name in BUNDLE.fieldNames():
        whole = whole & F.col(f"_b.{name}").isNotNull()
    places = F.transform(commands, lambda c: F.struct(*[c[f].alias(f) for f in LOG_ORDER]))
    ids = F.transform(commands, lambda c: c["command_id"])
    status = (
        F.when(F.col("status") != "read", F.col("status"))
        .when(F.col("_digest").isNull(), "unreadable")
        .when(~F.coalesce(whole, F.lit(False)), "incomplete")
        .when(F.col("_b.digest") != F.col("_digest"), "digest_mismatch")
        .when(F.size(commands) > max_commands, "too_many_commands")
        .when(F.array_sort(places) != places, "not_ordered")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated_command")
        .otherwise("accepted")
    )
    return parsed.withColumn("status", status).select(
        "path", "status", F.when(F.col("status") == "accepted", F.col("_b")).alias("bundle")
    )


def read_bundles(spark: SparkSession, folder: str, pattern: str, max_bytes: int, max_commands: int) -> DataFrame:
    """Bundles of a folder; files beyond ``max_bytes`` are told by their metadata and never read.

    Files of no bytes give no row: the file reader of Spark passes over them.
    """
    return checked_bundles(read_files(spark, folder, pattern, max_bytes), max_commands)
