"""Integer ratios in parts per million and money in millionths, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PPM = 1_000_000


def int_div(numerator: Column, denominator: Column) -> Column:
    return F.call_function("div", numerator, denominator)


def ppm(numerator: Column, denominator: Column) -> Column:
    """Share in ppm; a denominator of zero or less stops the job."""
    n, d = numerator.cast("bigint"), denominator.cast("bigint")
    checked = F.when(d > 0, d).otherwise(
        F.raise_error(F.lit("ratio denominator must be positive")).cast("bigint")
    )
    return int_div(n * PPM + int_div(d, F.lit(2)), checked)


def share_ppm(value: Column, total: Column) -> Column:
    """Share in ppm, zero where the total is zero."""
    v, t = value.cast("bigint"), total.cast("bigint")
    return F.when(t == 0, F.lit(0).cast("bigint")).otherwise(
        int_div(v * PPM + int_div(t, F.lit(2)), t)
    )


def improvement_ppm(baseline: Column, improved: Column) -> Column:
    """Signed improvement over the baseline; the magnitude is rounded half up."""
    b, i = baseline.cast("bigint"), improved.cast("bigint")
    magnitude = int_div(F.abs(b - i) * PPM + int_div(b, F.lit(2)), b)
    return F.when(b >= i, magnitude).otherwise(-magnitude)


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return int_div(F.octet_length(text).cast("bigint") + 3, F.lit(4))


def cost_micro_usd(
    input_tokens: Column, output_tokens: Column, input_price: int, output_price: int
) -> Column:
    """Price of a call, rounded up; prices are micro-dollars per million tokens."""
    spent = input_tokens.cast("bigint") * input_price + output_tokens.cast("bigint") * output_price
    return int_div(spent + (PPM - 1), F.lit(PPM))
