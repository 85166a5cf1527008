"""Contracts of candidate batches, run manifests and model answers, for any number of them at once.

Broken rules come out as issue rows (see :mod:`lectern.operators.constraints`).  Batches
and runs are compared place by place, so that a large one spreads over many tasks;
answers are checked row by row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import not_blank
from lectern.operators.answers import LISTED_CLAIMS, SINGLE_CLAIMS
from lectern.operators.constraints import ISSUE_FIELDS, differs, row_issues


@dataclass(frozen=True)
class BatchLimits:
    pool: int
    shortlist: int
    full: int


def batch_issues(candidates: DataFrame, rankings: DataFrame, selections: DataFrame, limits: BatchLimits) -> DataFrame:
    """One issue per run and broken rule of its candidate batch.

    ``candidates`` holds (run_id, pos, paper_id) and ``rankings`` (run_id, pos, paper_id, rank,
    llm_score), both with ``pos`` from 1; ``selections`` holds (run_id, kind, pos, paper_id)
    with kind ``shortlist`` or ``full``.  A selection must be the first papers of the batch,
    as many as its limit or the batch allows.  A place that occurs twice or not at all
    counts as out of order.
    """

    def placed(rows: DataFrame, part: Column, rank: Column = F.lit(None), scored: Column = F.lit(False)) -> DataFrame:
        return rows.select(
            "run_id", F.col("pos").cast("bigint").alias("pos"), F.col("paper_id").cast("string").alias("paper_id"),
            part.alias("part"), rank.cast("bigint").alias("rank"), scored.alias("scored"),
        )

    everything = placed(candidates, F.lit("candidate")).unionByName(
        placed(rankings, F.lit("ranking"), F.col("rank"), F.col("llm_score").isNotNull())
    ).unionByName(placed(selections, F.col("kind")))
    parts = ("candidate", "ranking", "shortlist", "full")
    at = everything.groupBy("run_id", "pos").agg(
        *[F.min(F.when(F.col("part") == p, F.col("paper_id"))).alias(p) for p in parts],
        *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in parts],
        F.min("rank").alias("rank"), F.bool_or("scored").alias("scored"),
    )

    def strays(part: str, limit: int | None) -> Column:
        wanted = (F.col("n_candidate") > 0) & (F.lit(True) if limit is None else F.col("pos") <= limit)
        twice_or_none = F.col(f"n_{part}") != wanted.cast("int")
        return F.bool_or(twice_or_none | (wanted & differs(F.col(part), F.col("candidate"))))

    per_run = at.groupBy("run_id").agg(
        F.sum("n_candidate").alias("size"),
        F.coalesce(F.max(F.when(F.col("n_candidate") > 0, F.col("pos"))), F.lit(0)).alias("last"),
        F.coalesce(F.min(F.when(F.col("n_candidate") > 0, F.col("pos"))), F.lit(1)).alias("first"),
        F.bool_or(F.col("n_candidate") > 1).alias("place_twice"),
        strays("ranking", None).alias("ranking_strays"),
        F.bool_or((F.col("n_ranking") > 0) & differs(F.col("rank"), F.col("pos"))).alias("rank_strays"),
        strays("shortlist", limits.shortlist).alias("shortlist_strays"),
        strays("full", limits.full).alias("full_strays"),
        F.bool_or("scored").alias("scored"),
    )
    repeated = candidates.groupBy("run_id", "paper_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select("run_id", F.lit(True).alias("repeated")).distinct()
    return row_issues(
        per_run.join(repeated, "run_id", "left"),
        {
            "candidates_over_pool": F.col("size") > limits.pool,
            "candidate_id_not_unique": F.col("repeated"),
            "candidate_place_missing": F.col("place_twice") | (F.col("first") != 1) | (F.col("last") != F.col("size")),
            "ranking_not_in_candidate_order": F.col("ranking_strays"),
            "rank_not_consecutive": F.col("rank_strays"),
            "shortlist_not_prefix": F.col("shortlist_strays"),
            "full_analysis_not_prefix": F.col("full_strays"),
            "llm_score_before_its_stage": F.col("scored"),
        },
        paper_id="run_id",
    )


def derived_status(stages: DataFrame, order: Sequence[str]) -> DataFrame:
    """(run_id, in_order, derived_status, sums) of every run from its stages (run_id, pos, stage, status, counters).

    The first stage of ``order`` may leave the run empty; a failure of the last one only degrades it.
    """
    names = F.array(*[F.lit(n) for n in order])
    fits = F.coalesce(F.get(names, (F.col("pos") - 1).cast("int")) == F.col("stage"), F.lit(False))
    bit = F.when(fits, F.expr("shiftleft(1L, cast(pos - 1 AS int))")).otherwise(F.lit(0))
    status, last = F.col("status"), F.col("stage") == order[-1]
    summed = [F.sum(c).alias(f"stage_{c}") for c in ("cache_hit_count", "retry_count", "partial_failure_count")]
    derived = (
        F.when(F.bool_or((F.col("stage") == order[0]) & (status == "empty")), "empty")
        .when(F.bool_or((status == "failed") & ~last), "failed")
        .when(F.bool_or((status == "partial") | (F.col("partial_failure_count") > 0) | ((status == "failed") & last)), "partial")
        .otherwise("success")
    )
    return stages.groupBy("run_id").agg(
        ((F.count("*") == len(order)) & (F.bit_or(bit) == (1 << len(order)) - 1)).alias("in_order"),
        derived.alias("derived_status"), *summed,
    )


def manifest_issues(manifests: DataFrame, stages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Manifests that contradict their stages, their site or their delivery.

    ``manifests`` holds one row per run: run_id, status, started_at, completed_at, dry_run,
    send_requested, the three counters, published_count, delivered_count, artifact_hash and
    what the site and the delivery reported (site_published_count, site_artifact_hash,
    delivery_status, delivery_count).  A run without stages is out of order.
    """
    c = F.col
    joined = manifests.join(derived_status(stages, order), "run_id", "left")
    totals = {
        f"{name}_total_mismatch": differs(c(name), F.coalesce(c(f"stage_{name}"), F.lit(0)))
        for name in ("cache_hit_count", "retry_count", "partial_failure_count")
    }
    return row_issues(
        joined,
        {
            "completed_before_started": c("completed_at") < c("started_at"),
            "dry_run_requests_sending": c("dry_run") & c("send_requested"),
            "stages_out_of_order": ~F.coalesce(c("in_order"), F.lit(False)),
            **totals,
            "published_count_mismatch": differs(c("published_count"), c("site_published_count")),
            "delivered_count_mismatch": differs(c("delivered_count"), c("delivery_count")),
            "artifact_hash_mismatch": differs(c("artifact_hash"), c("site_artifact_hash")),
            "sent_without_request": (c("delivery_status") == "sent") & (c("dry_run") | ~c("send_requested")),
            "run_status_not_derived": c("derived_status").isNotNull() & differs(c("status"), c("derived_status")),
        },
        paper_id="run_id",
    )


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]))


def _repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def _origin_differs(row: Column) -> Column:
    return differs(row["inferred"], F.coalesce(row["source_type"] == "system_inference", F.lit(False)))


def _claim_rules(claim: Column, kind: str) -> dict[str, Column]:
    return {
        "claim_id_blank": ~not_blank(claim["claim_id"]),
        "claim_text_blank": ~not_blank(claim["text"]),
        "claim_kind_mismatch": differs(claim["kind"], F.lit(kind)),
        "claim_evidence_repeated": _repeats(claim["evidence_ids"]),
        "claim_origin_mismatch": _origin_differs(claim),
        "confidence_out_of_range": ~F.coalesce(claim["confidence"].between(0, 1), F.lit(False)),
    }


def _row_rules(field: str, row: Column) -> dict[str, Column]:
    if field == "supporting_visuals":
        cited = F.coalesce(F.array_contains(row["support_explanation"]["evidence_ids"], row["evidence_id"]), F.lit(False))
        return {
            "visual_id_blank": ~not_blank(row["evidence_id"]),
            "visual_without_insight": F.coalesce(F.size(row["insight_ids"]), F.lit(0)) < 1,
            "visual_not_cited": ~cited,
        }
    if field == "method_modules":
        return {"module_name_blank": ~not_blank(row["name"])}
    if field == "parameters":
        return {
            "parameter_name_blank": ~not_blank(row["name"]),
            "parameter_references_repeated": _repeats(row["evidence_ids"]) | _repeats(row["ablation_ids"]),
            "parameter_origin_mismatch": _origin_differs(row),
            "parameter_confidence_out_of_range": ~F.coalesce(row["confidence"].between(0, 1), F.lit(False)),
        }
    if field == "ablations":
        return {
            "ablation_id_blank": ~not_blank(row["ablation_id"]),
            "ablation_without_visual": F.coalesce(F.size(row["visual_evidence_ids"]), F.lit(0)) < 1,
        }
    return {}


def answer_issues(parsed: DataFrame, paper_id: str = "paper_id") -> DataFrame:
    """Claims and rows of parsed answers (see ``answers.parse``) that break the contract of their field.

    Every claim, and beside it every visual, module, parameter and ablation, is checked in
    place; a claim that its row lacks is ``claim_missing``.  Answers without an analysis give nothing.
    """
    a = F.col("analysis")

    def found(path: Column, claim: Column, kind: str, more: dict[str, Column]) -> Column:
        own = F.when(claim.isNull(), F.array(F.lit("claim_missing"))).otherwise(_broken(_claim_rules(claim, kind)))
        return F.struct(path.alias("path"), claim["claim_id"].alias("claim"), F.concat(own, _broken(more)).alias("codes"))

    single = F.array(*[F.when(a[f].isNotNull(), found(F.lit(f), a[f], kind, {})) for f, kind in SINGLE_CLAIMS])

    def listed(field: str, member: str | None, kind: str) -> Column:
        suffix = f".{member}" if member else ""

        def check(row: Column, i: Column) -> Column:
            path = F.concat(F.lit(f"{field}."), i.cast("string"), F.lit(suffix))
            return found(path, row[member] if member else row, kind, _row_rules(field, row))

        return F.transform(a[field], check)

    everything = F.concat(F.array_compact(single), *[listed(*entry) for entry in LISTED_CLAIMS])
    broken = F.filter(everything, lambda e: F.size(e["codes"]) > 0)
    rows = parsed.where("analysis IS NOT NULL").select(F.col(paper_id).alias("paper_id"), F.explode(broken).alias("_e"))
    exploded = rows.select("paper_id", "_e.path", "_e.claim", F.explode("_e.codes").alias("code"))
    places = {"claim_id": F.col("claim"), "field_path": F.col("path")}
    return exploded.select(
        "code", F.lit("error").alias("severity"), "paper_id",
        *[places.get(f, F.lit(None)).cast("string").alias(f) for f in ISSUE_FIELDS[1:]],
    )
