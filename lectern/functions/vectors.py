"""Vector arithmetic on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def positive(value: Column, message: str) -> Column:
    """``value`` where it is a finite number above zero; any other value, NaN too, stops the job."""
    finite = ~F.isnan(value) & (value < float("inf"))
    return F.when((value > 0) & finite, value).otherwise(F.raise_error(F.lit(message)).cast("double"))
