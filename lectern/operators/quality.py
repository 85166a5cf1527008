"""Quality and run metrics in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.fixedpoint import improvement_ppm, ppm, share_ppm
from lectern.operators.scan import nearest_rank_percentiles

# The gain of a relevant row at ranks 1 to 5, in ppm.
NDCG_DISCOUNTS = (1_000_000, 630_930, 500_000, 430_677, 386_853)

# Upper limits of one run.
BUDGET_LIMITS = {
    "candidate_count": 30,
    "selected_for_llm_count": 15,
    "selected_for_analysis_count": 5,
    "successful_analysis_call_count": 5,
    "analysis_attempt_count": 15,
    "configured_output_token_count": 40_960,
    "offline_network_call_count": 0,
    "offline_paid_call_count": 0,
    "peak_traced_allocation_bytes": 256 * 1024 * 1024,
}


#: Fewest pairs of timings that are compared.
MIN_PAIRS = 9


def _require(good: Column, message: str) -> Column:
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def ranking_quality(rankings: DataFrame, keys: list[str]) -> DataFrame:
    """precision@5, recall@15 and NDCG@5 per key; rows carry ``rank`` (1..n) and ``relevant``."""
    rank, relevant = F.col("rank"), F.col("relevant")
    discounts = F.array(*[F.lit(d).cast("bigint") for d in NDCG_DISCOUNTS])
    gain = F.when(relevant & (rank <= 5), F.get(discounts, (rank - 1).cast("int"))).otherwise(F.lit(0))
    counted = rankings.groupBy(*keys).agg(
        F.count("*").alias("evaluated_count"),
        F.count_if(relevant).alias("relevant_count"),
        F.count_if(relevant & (rank <= 5)).alias("_top5"),
        F.count_if(relevant & (rank <= 15)).alias("_top15"),
        F.sum(gain).alias("_dcg"),
        F.min("rank").alias("_first"),
        F.max("rank").alias("_last"),
        F.countDistinct("rank").alias("_distinct"),
    )
    ideal = F.aggregate(
        F.slice(discounts, 1, F.least(F.col("relevant_count"), F.lit(5)).cast("int")),
        F.lit(0).cast("bigint"),
        lambda total, d: total + d,
    )
    return counted.where(
        _require(F.col("evaluated_count") >= 15, "at least fifteen ranked items are needed")
        & _require(
            (F.col("_first") == 1)
            & (F.col("_last") == F.col("evaluated_count"))
            & (F.col("_distinct") == F.col("evaluated_count")),
            "every rank from one to the number of items must occur once",
        )
    ).select(
        *keys,
        "evaluated_count",
        "relevant_count",
        ppm(F.col("_top5"), F.lit(5)).alias("precision_at_5_ppm"),
        ppm(F.col("_top15"), F.col("relevant_count")).alias("recall_at_15_ppm"),
        ppm(F.col("_dcg"), ideal).alias("ndcg_at_5_ppm"),
    )


def label_quality(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence precision and recall, unsupported-claim rate and missing-field rate per key.

    Rows carry ``domain`` (evidence, claim or field) and the boolean columns
    ``expected``, ``accepted``, ``supported`` and ``present``.
    """
    is_evidence, is_claim, is_field = (F.col("domain") == d for d in ("evidence", "claim", "field"))
    expected, accepted = F.col("expected"), F.col("accepted")
    counted = labels.groupBy(*keys).agg(
        F.count_if(is_evidence & expected).alias("expected_evidence_count"),
        F.count_if(is_evidence & accepted).alias("accepted_evidence_count"),
        F.count_if(is_evidence & expected & accepted).alias("supported_evidence_count"),
        F.count_if(is_evidence & expected & ~accepted).alias("rejected_evidence_count"),
        F.count_if(is_claim & accepted).alias("accepted_claim_count"),
        F.count_if(is_claim & accepted & F.col("supported")).alias("supported_claim_count"),
        F.count_if(is_field).alias("required_field_count"),
        F.count_if(is_field & F.col("present")).alias("present_field_count"),
    )
    c = F.col
    return counted.select(
        "*",
        ppm(c("supported_evidence_count"), c("accepted_evidence_count")).alias("evidence_precision_ppm"),
        ppm(c("supported_evidence_count"), c("expected_evidence_count")).alias("evidence_recall_ppm"),
        ppm(c("accepted_claim_count") - c("supported_claim_count"), c("accepted_claim_count")).alias(
            "unsupported_claim_rate_ppm"
        ),
        ppm(c("required_field_count") - c("present_field_count"), c("required_field_count")).alias(
            "missing_required_field_rate_ppm"
        ),
    )


def retrieval_metrics(scored: DataFrame, score: str, key: str, relevant: str, top_k: int) -> DataFrame:
    """Floating NDCG, precision and recall at k, rounded half to even to ppm; ties keep key order."""
    order = [F.col(score).desc(), F.col(key).asc()]
    top = scored.select(score, key, relevant).orderBy(*order).limit(top_k)
    gains = top.withColumn("_rank", F.row_number().over(Window.orderBy(*order))).agg(
        F.count("*").alias("_selected"),
        F.count_if(relevant).alias("_hits"),
        F.sum(F.when(F.col(relevant), 1.0 / F.log2(F.col("_rank") + 1)).otherwise(0.0)).alias("_dcg"),
    )
    total = scored.agg(F.count_if(relevant).alias("n")).scalar()
    with_total = gains.withColumn("relevant_count", total)
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("relevant_count"), F.col("_selected")).cast("int")),
        F.lit(0.0),
        lambda t, i: t + 1.0 / F.log2(i + 1),
    )

    def as_ppm(value: Column) -> Column:
        return F.bround(value * 1_000_000, 0).cast("bigint")

    return with_total.select(
        "relevant_count",
        as_ppm(F.col("_dcg") / ideal).alias(f"ndcg_at_{top_k}_ppm"),
        as_ppm(F.col("_hits") / F.col("_selected")).alias(f"precision_at_{top_k}_ppm"),
        as_ppm(F.col("_hits") / F.col("relevant_count")).alias(f"recall_at_{top_k}_ppm"),
    )


def paired_comparison(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Compare ``improved`` against ``baseline`` timings; rows carry ``variant`` and integer ``ns``.

    Fewer than ``MIN_PAIRS`` pairs, or unequal numbers of both variants, stop the job.
    """
    percentiles = nearest_rank_percentiles(samples, [*keys, "variant"], "ns", [50, 95])

    def pick(variant: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    wide = percentiles.groupBy(*keys).agg(
        pick("baseline", "n").alias("pair_count"),
        pick("improved", "n").alias("_improved_count"),
        pick("baseline", "p50").alias("baseline_median_ns"),
        pick("improved", "p50").alias("improved_median_ns"),
        pick("baseline", "p95").alias("baseline_p95_ns"),
        pick("improved", "p95").alias("improved_p95_ns"),
    )
    paired = _require(
        F.col("pair_count").eqNullSafe(F.col("_improved_count")) & (F.col("pair_count") >= MIN_PAIRS),
        "timings must come in at least nine pairs",
    )
    return (
        wide.where(paired).drop("_improved_count").withColumn(
            "improvement_ppm", improvement_ppm(F.col("baseline_median_ns"), F.col("improved_median_ns"))
        )
        .withColumn("p95_ratio_ppm", share_ppm(F.col("improved_p95_ns"), F.col("baseline_p95_ns")))
        .withColumn(
            "passed", (F.col("improvement_ppm") >= 100_000) & (F.col("p95_ratio_ppm") <= 1_050_000)
        )
    )


def hot_spots(profile: DataFrame, total_time: Column, total_bytes: Column) -> DataFrame:
    """Eligible profile rows that hold at least a fifth of time or memory, with their shares."""
    shared = profile.where("eligible").select(
        "*",
        share_ppm(F.col("cumulative_time"), total_time).alias("time_share_ppm"),
        share_ppm(F.col("allocation_bytes"), total_bytes).alias("allocation_share_ppm"),
    )
    return shared.withColumn(
        "largest_share_ppm", F.greatest("time_share_ppm", "allocation_share_ppm")
    )


def optimization_target(shared: DataFrame, threshold_ppm: int = 200_000) -> DataFrame:
    """The row with the largest share; ties go to more time, then to the smaller symbol."""
    return (
        shared.where(F.col("largest_share_ppm") >= threshold_ppm)
        .orderBy(F.desc("largest_share_ppm"), F.desc("cumulative_time"), F.asc("symbol"))
        .limit(1)
    )


def budget_verdict(runs: DataFrame) -> DataFrame:
    """Add ``passed``: every counter inside its limit and, where priced, the cost inside its cap."""
    inside = F.lit(True)
    for counter, limit in BUDGET_LIMITS.items():
        inside = inside & (F.col(counter) <= limit)
    cap = F.col("maximum_batch_cost_micro_usd")
    cost = F.coalesce(F.col("estimated_cost_micro_usd") <= cap, F.lit(False))
    return runs.withColumn("passed", inside & (cap.isNull() | cost))


def first_seen_codes(rows: DataFrame, keys: list[str], code: str, position: str) -> DataFrame:
    """Distinct codes per key in order of first appearance; the code vocabulary is small and fixed."""
    firsts = rows.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.min(position).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", code)))
    return firsts.groupBy(*keys).agg(
        F.transform(ordered, lambda e: e[code]).alias("error_codes")
    )


def stage_rollup(papers: DataFrame, keys: list[str]) -> DataFrame:
    """Stage status from paper statuses: failed without output, partial with any failure, else success."""
    counted = papers.groupBy(*keys).agg(
        F.count("*").alias("input_count"),
        F.count_if(F.col("status").isin("success", "partial")).alias("output_count"),
        F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("partial_failure_count"),
    )
    return counted.withColumn(
        "stage_status",
        F.when(F.col("output_count") == 0, "failed")
        .when(F.col("partial_failure_count") > 0, "partial")
        .otherwise("success"),
    )


def run_status(stages: DataFrame, key: str) -> DataFrame:
    """Run status from its stages; a failed delivery only degrades the run."""
    status, delivery = F.col("status"), F.col("stage") == "delivery"
    return stages.groupBy(key).agg(
        F.when(F.bool_or((F.col("stage") == "candidates") & (status == "empty")), "empty")
        .when(F.bool_or((status == "failed") & ~delivery), "failed")
        .when(
            F.bool_or((status == "partial") | (F.col("partial_failure_count") > 0)
                      | ((status == "failed") & delivery)),
            "partial",
        )
        .otherwise("success")
        .alias("run_status")
    )


def reconciled_metrics(measured: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Measured durations beside the stage results of the same ``keys``, with ``mismatch`` where one side is missing.

    A stage without a measurement is ``unmeasured``, a measurement without a stage ``unknown_stage``.
    """
    left = measured.select(*keys, "duration_ns", F.lit(True).alias("_measured"))
    joined = left.join(results.withColumn("_result", F.lit(True)), keys, "full_outer")
    mismatch = F.when(F.col("_measured").isNull(), "unmeasured").when(F.col("_result").isNull(), "unknown_stage")
    return joined.withColumn("mismatch", mismatch).drop("_measured", "_result")


def profile_exclusion(path: Column, function: Column, rules: dict[str, list[tuple[str, str | None]]]) -> Column:
    """Why a profile row is no target: generated code (its name starts with ``<``), else the first rule that fits.

    ``rules`` maps a code to (path, function) pairs; None for the function takes the whole file.
    """
    code = F.when(function.startswith("<"), "generated_wrapper")
    for name, places in rules.items():
        for file, only in places:
            fits = path == file if only is None else (path == file) & (function == only)
            code = code.when(fits, name)
    return code
