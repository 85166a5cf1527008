"""Opaque models as Arrow-batched functions, and table-backed stand-ins for offline runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Encoder = Callable[[list[str]], list[list[float]]]
TextModel = Callable[[list[str]], list[str]]


def encoder_column(load: Callable[[], Encoder], batch: int = 64):
    """A column function text -> vector; ``load`` runs once per task, texts go in batches."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors: list[list[float]] = []
            for start in range(0, len(texts), batch):
                vectors.extend(model(texts.iloc[start : start + batch].tolist()))
            yield pd.Series(vectors)

    return encode


def text_model_column(load: Callable[[], TextModel]):
    """A column function prompt -> answer for summaries, affiliations and structured analyses."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()))

    return answer


def from_table(inputs: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Look values up instead of computing them; an input without an entry stops the job."""
    joined = inputs.join(known.select(key, value), key, "left")
    missing = F.raise_error(F.lit(f"no stored {value} for an input")).cast(dict(known.dtypes)[value])
    return joined.withColumn(value, F.coalesce(value, missing))
