"""Rules that report violations as rows instead of raising.

An issue row is ``(code, severity, paper_id, claim_id, field_path, evidence_id,
visual_id)``.  All row-level rules of one relation are checked in a single pass
over it; rules that need another relation join first and then do the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ISSUE_FIELDS = ("paper_id", "claim_id", "field_path", "evidence_id", "visual_id")


def row_issues(
    df: DataFrame, rules: dict[str, Column], paper_id: str = "paper_id", warnings: tuple[str, ...] = (), **location: Column
) -> DataFrame:
    """One issue per row and broken rule; ``location`` fills the optional issue columns."""
    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()])
    )
    place = [location.get(f, F.lit(None)).cast("string").alias(f) for f in ISSUE_FIELDS[1:]]
    return df.select(
        F.explode(codes).alias("code"), F.col(paper_id).alias("paper_id"), *place
    ).select(
        "code",
        F.when(F.col("code").isin(*warnings), "warning").otherwise("error").alias("severity")
        if warnings
        else F.lit("error").alias("severity"),
        *ISSUE_FIELDS,
    )


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def ranking_issues(ranked: DataFrame) -> DataFrame:
    """Ranks run 1..n by falling score and rising id; scores add up; the selections are prefixes.

    ``ranked`` is one bounded batch (at most the pool size).
    """
    by_rank = Window.orderBy("rank")
    prior_score, prior_id = F.lag("final_score").over(by_rank), F.lag("paper_id").over(by_rank)
    checked = ranked.select(
        "paper_id", "rank", "embedding_score", "feedback_adjustment", "final_score",
        "in_shortlist", "in_full_analysis",
        F.row_number().over(by_rank).alias("_place"),
        ((prior_score < F.col("final_score"))
         | ((prior_score == F.col("final_score")) & (prior_id >= F.col("paper_id")))).alias("_unordered"),
        F.lag("in_shortlist", 1, True).over(by_rank).alias("_prior_shortlist"),
        F.lag("in_full_analysis", 1, True).over(by_rank).alias("_prior_full"),
    )
    return row_issues(
        checked,
        {
            "rank_not_consecutive": F.col("rank") != F.col("_place"),
            "ranking_not_ordered": F.col("_unordered"),
            "score_sum_mismatch": F.abs(
                F.col("final_score") - F.col("embedding_score") - F.col("feedback_adjustment")
            ) > 1e-12,
            "score_out_of_range": ~F.col("final_score").between(-10, 10),
            "shortlist_not_prefix": F.col("in_shortlist") & ~F.col("_prior_shortlist"),
            "full_analysis_not_prefix": F.col("in_full_analysis") & ~F.col("_prior_full"),
            "full_analysis_not_in_shortlist": F.col("in_full_analysis") & ~F.col("in_shortlist"),
        },
    )


def candidate_issues(candidates: DataFrame) -> DataFrame:
    """Identity, category and date rules of a candidate paper."""
    return row_issues(
        candidates,
        {
            "paper_id_not_derived": differs(F.col("paper_id"), F.concat(F.lit("arxiv:"), F.col("arxiv_id"))),
            "arxiv_id_not_base": ~F.col("arxiv_id").rlike(r"^(?i)(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})$"),
            "primary_category_missing": ~F.array_contains("categories", F.col("primary_category")),
            "updated_before_published": F.col("updated_at") < F.col("published_at"),
            "authors_empty": F.size("authors") == 0,
        },
    )


def stage_issues(stages: DataFrame) -> DataFrame:
    """What each stage status allows in its counters and error codes."""
    status, has_codes = F.col("status"), F.size("error_codes") > 0
    failures, output = F.col("partial_failure_count") > 0, F.col("output_count") > 0
    work = output | (F.col("cache_hit_count") > 0) | (F.col("retry_count") > 0) | failures
    return row_issues(
        stages,
        {
            "success_with_failures": (status == "success") & (failures | has_codes),
            "partial_without_failure": (status == "partial") & ~(failures | has_codes),
            "failed_with_output": (status == "failed") & (output | ~has_codes),
            "empty_with_output": (status == "empty") & (output | failures | has_codes),
            "skipped_with_work": (status == "skipped")
            & (work | ((F.col("input_count") > 0) & ~has_codes)),
        },
        paper_id="run_id",
        field_path=F.col("stage"),
    )


def funnel_issues(counts: DataFrame, key: str) -> DataFrame:
    """Counts may only shrink along the run."""
    c = F.col
    return row_issues(
        counts,
        {
            "selected_exceeds_candidates": c("selected_count") > c("candidate_count"),
            "analyzed_exceeds_selected": c("analyzed_count") > c("selected_count"),
            "validated_exceeds_analyzed": c("validated_count") > c("analyzed_count"),
            "published_exceeds_validated": c("published_count") > c("validated_count"),
            "delivered_exceeds_validated": c("delivered_count") > c("validated_count"),
        },
        paper_id=key,
    )


def total_issues(totals: DataFrame, stages: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Run totals that are not the sum of their stages."""
    summed = stages.groupBy(key).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    joined = totals.join(summed, key, "left")
    return row_issues(
        joined,
        {f"{m}_total_mismatch": differs(F.col(m), F.coalesce(F.col(f"_{m}"), F.lit(0))) for m in measures},
        paper_id=key,
    )


def graph_issues(
    pages: DataFrame, blocks: DataFrame, sections: DataFrame, section_blocks: DataFrame
) -> DataFrame:
    """Document-graph rules over pages, blocks, sections and section membership, per ``doc_id``."""
    page_of = pages.select("doc_id", "pdf_page", "width", "height")
    section_keys = sections.select("doc_id", "section_id", F.lit(True).alias("_known"))
    placed = (
        blocks.join(page_of, ["doc_id", "pdf_page"], "left")
        .join(section_keys, ["doc_id", "section_id"], "left")
    )
    inside = (
        (F.col("left") >= 0) & (F.col("top") >= 0)
        & (F.col("right") <= F.col("width")) & (F.col("bottom") <= F.col("height"))
    )
    block_level = row_issues(
        placed,
        {
            "block_outside_page": F.col("width").isNull() | ~inside,
            "block_without_area": (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top")),
            "dangling_section_reference": F.col("section_id").isNotNull() & F.col("_known").isNull(),
        },
        paper_id="doc_id",
        field_path=F.concat(F.lit("blocks."), F.col("block_id")),
    )
    members = section_blocks.select("doc_id", "section_id", "block_id", F.lit(True).alias("_listed"))
    owners = blocks.where("section_id IS NOT NULL").select(
        "doc_id", "section_id", "block_id", F.col("pdf_page").alias("_page")
    )
    both = members.join(owners, ["doc_id", "section_id", "block_id"], "full_outer")
    membership = row_issues(
        both,
        {
            "membership_not_in_block": F.col("_page").isNull(),
            "membership_not_in_section": F.col("_listed").isNull(),
        },
        paper_id="doc_id",
        field_path=F.concat(F.lit("blocks."), F.col("block_id")),
    )
    spans = owners.groupBy("doc_id", "section_id").agg(
        F.min("_page").alias("_first"), F.max("_page").alias("_last")
    )
    parents = sections.select("doc_id", F.col("section_id").alias("parent_id"), F.lit(True).alias("_parent"))
    ranged = sections.join(spans, ["doc_id", "section_id"], "left").join(
        parents, ["doc_id", "parent_id"], "left"
    )
    section_level = row_issues(
        ranged,
        {
            "section_range_mismatch": F.col("_first").isNotNull()
            & ((F.col("start_pdf_page") != F.col("_first")) | (F.col("end_pdf_page") != F.col("_last"))),
            "dangling_parent_reference": F.col("parent_id").isNotNull() & F.col("_parent").isNull(),
        },
        paper_id="doc_id",
        field_path=F.concat(F.lit("sections."), F.col("section_id")),
    )
    repeated = row_issues(
        duplicates(blocks, "doc_id", "block_id"),
        {"block_id_not_unique": F.lit(True)},
        paper_id="doc_id",
        field_path=F.concat(F.lit("blocks."), F.col("block_id")),
    )
    return block_level.unionByName(membership).unionByName(section_level).unionByName(repeated)
