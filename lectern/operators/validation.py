"""Checking claims, visuals, parameters and ablations against an evidence packet.

Claims point to evidence through an edge relation, so a claim or paper with very
many references is only ever counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.constraints import differs, duplicates, row_issues
from lectern.operators.hierarchy import ancestor_paths

INFERENCE = "system_inference"


def known_evidence(packet: DataFrame) -> DataFrame:
    """One row per paper and evidence id; of repeated ids the last one counts."""
    return packet.groupBy("paper_id", "evidence_id").agg(
        F.max_by("abstract_only", "pos").alias("abstract_only"),
        F.max_by("kind", "pos").alias("evidence_kind"),
    )


def claim_facts(claims: DataFrame, edges: DataFrame, packet: DataFrame) -> DataFrame:
    """Each claim with what its references amount to."""
    refs = edges.groupBy("paper_id", "claim_pos", "evidence_id").agg(F.count("*").alias("_uses"))
    resolved = refs.join(known_evidence(packet), ["paper_id", "evidence_id"], "left")
    known = F.col("evidence_kind").isNotNull()
    per_claim = resolved.groupBy("paper_id", "claim_pos").agg(
        F.bool_or(F.col("_uses") > 1).alias("_repeats"),
        F.count_if(~known).alias("_unknown"),
        F.count_if(known).alias("resolved_count"),
        F.bool_or(known & ~F.col("abstract_only")).alias("_grounded"),
    )
    ids = claims.groupBy("paper_id", "claim_id").agg(
        F.count("*").alias("_copies"), F.min("claim_pos").alias("_first")
    )
    return claims.join(per_claim, ["paper_id", "claim_pos"], "left").join(ids, ["paper_id", "claim_id"])


def _claim_rules() -> dict[str, Column]:
    return {
        "duplicate_claim_evidence_id": F.col("_repeats"),
        "claim_kind_mismatch": F.col("kind") != F.col("expected_kind"),
        "claim_source_inference_mismatch": F.col("inferred") != (F.col("source_type") == INFERENCE),
        "unknown_evidence": F.col("_unknown") > 0,
        "abstract_only_insight": (F.col("expected_kind") == "insight")
        & ~F.coalesce("_grounded", F.lit(False)),
    }


def claim_verdicts(facts: DataFrame) -> DataFrame:
    """Verdict per distinct claim id, from its first occurrence."""
    rules = {**_claim_rules(), "duplicate_claim_id": F.col("_copies") > 1}
    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()])
    )
    return facts.where(F.col("claim_pos") == F.col("_first")).select(
        "paper_id", "claim_id", "claim_pos",
        codes.alias("issue_codes"),
        F.when(F.size(codes) > 0, "invalid").otherwise("valid").alias("status"),
        F.coalesce("resolved_count", F.lit(0)).alias("resolved_count"),
    )


def claim_issues(facts: DataFrame, edges: DataFrame, packet: DataFrame) -> DataFrame:
    rules = _claim_rules()
    rules.pop("unknown_evidence")
    per_claim = row_issues(
        facts, rules, claim_id=F.col("claim_id"), field_path=F.concat(F.lit("claims."), F.col("claim_pos"))
    )
    dangling = edges.join(
        known_evidence(packet).select("paper_id", "evidence_id"), ["paper_id", "evidence_id"], "left_anti"
    )
    unknown = row_issues(
        dangling,
        {"unknown_evidence": F.lit(True)},
        evidence_id=F.col("evidence_id"),
        field_path=F.concat(F.lit("claims."), F.col("claim_pos"), F.lit(".evidence_ids")),
    )
    repeated_claims = row_issues(
        facts.where("_copies > 1 AND claim_pos = _first"),
        {"duplicate_claim_id": F.lit(True)},
        claim_id=F.col("claim_id"), field_path=F.lit("claims"),
    )
    repeated_evidence = row_issues(
        duplicates(packet, "paper_id", "evidence_id"),
        {"duplicate_evidence_id": F.lit(True)},
        evidence_id=F.col("evidence_id"), field_path=F.lit("evidence_candidates"),
    )
    return per_claim.unionByName(unknown).unionByName(repeated_claims).unionByName(repeated_evidence)


def missing_insight(claims: DataFrame) -> DataFrame:
    """A warning for each paper without any insight."""
    counted = claims.groupBy("paper_id").agg(F.count_if(F.col("expected_kind") == "insight").alias("_n"))
    return row_issues(
        counted, {"core_insight_missing": F.col("_n") == 0},
        warnings=("core_insight_missing",), field_path=F.lit("insights"),
    )


def report_status(papers: DataFrame, issues: DataFrame) -> DataFrame:
    """invalid with any error, partial with a warning or a partial analysis, else valid."""
    found = issues.groupBy("paper_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.bool_or(F.col("code") == "core_insight_missing").alias("_thin"),
    )
    joined = papers.select("paper_id", "analysis_status").join(found, "paper_id", "left")
    errors = F.coalesce("error_count", F.lit(0))
    status = (
        F.when(errors > 0, "invalid")
        .when((F.col("analysis_status") == "partial") | F.coalesce("_thin", F.lit(False)), "partial")
        .otherwise("valid")
    )
    unavailable = F.col("analysis_status").isin("failed", "skipped")
    return joined.select(
        "paper_id",
        errors.alias("error_count"),
        F.when(unavailable, F.lit(None).cast("string")).otherwise(status).alias("report_status"),
        F.when(unavailable, F.col("analysis_status"))
        .when(status == "valid", "validated").otherwise(status).alias("result_status"),
        F.when(~unavailable & (status == "valid"), "eligible").otherwise("blocked").alias("publication_eligibility"),
    )


def publication(reports: DataFrame, allow_partial: bool) -> DataFrame:
    full = (F.col("result_status") == "validated") & (F.col("publication_eligibility") == "eligible")
    partial = F.lit(allow_partial) & (F.col("result_status") == "partial")
    return reports.withColumn(
        "decision", F.when(full, "full").when(partial, "partial").otherwise("excluded")
    )


def digest(reports: DataFrame, claims: DataFrame, visuals: DataFrame) -> DataFrame:
    """First insight, first conclusion and strongest visual of each publishable paper."""
    eligible = reports.where(
        "result_status = 'validated' AND publication_eligibility = 'eligible'"
    ).select("paper_id")

    def first(kind):
        return F.min_by(F.when(F.col("expected_kind") == kind, F.col("claim_id")),
                        F.when(F.col("expected_kind") == kind, F.col("claim_pos")))

    texts = claims.groupBy("paper_id").agg(
        first("insight").alias("core_insight"), first("result").alias("experimental_conclusion")
    )
    strongest = visuals.groupBy("paper_id").agg(
        F.max_by(
            F.struct("label", "pdf_page"), F.struct("confidence", -F.col("pos"), "label", "pdf_page")
        ).alias("_v")
    )
    return eligible.join(texts, "paper_id", "left").join(strongest, "paper_id", "left").select(
        "paper_id", "core_insight", "experimental_conclusion",
        F.col("_v.label").alias("evidence_label"), F.col("_v.pdf_page").alias("evidence_page"),
    )


def visual_issues(visuals: DataFrame, claims: DataFrame, packet: DataFrame) -> DataFrame:
    """Rules of supporting visuals; ``insight_pos`` names the claim a visual supports."""
    evidence = packet.groupBy("paper_id", "evidence_id").agg(
        F.max_by(F.struct("kind", "label", "pdf_page"), "pos").alias("_e")
    )
    insights = claims.where("expected_kind = 'insight'").select(
        "paper_id", F.col("claim_pos").alias("insight_pos"), F.lit(True).alias("_insight")
    ).distinct()
    joined = visuals.join(evidence, ["paper_id", "evidence_id"], "left").join(
        insights, ["paper_id", "insight_pos"], "left"
    )
    candidate = F.col("_e")
    is_visual = candidate.isNotNull() & (candidate["kind"] != "text")
    per_visual = row_issues(
        joined,
        {
            "supporting_visual_requires_figure_or_table": ~is_visual,
            "supporting_visual_unknown_insight": F.col("_insight").isNull(),
            "invalid_support_explanation": (F.col("explanation_kind") != "support") | ~F.col("explanation_cites"),
            "supporting_visual_provenance_mismatch": is_visual
            & (
                differs(F.col("kind"), candidate["kind"])
                | differs(F.col("label"), candidate["label"])
                | differs(F.col("pdf_page"), candidate["pdf_page"])
            ),
        },
        evidence_id=F.col("evidence_id"),
        field_path=F.concat(F.lit("supporting_visuals."), F.col("pos")),
    )
    too_many = row_issues(
        visuals.groupBy("paper_id").agg(F.count("*").alias("_n")),
        {"too_many_supporting_visuals": F.col("_n") > 3},
        field_path=F.lit("supporting_visuals"),
    )
    return per_visual.unionByName(too_many)


def parameter_issues(
    parameters: DataFrame, parameter_refs: DataFrame, ablations: DataFrame, ablation_refs: DataFrame, packet: DataFrame
) -> DataFrame:
    """Rules between parameters and ablations.

    References are rows ``(paper_id, pos, target, ref)`` with target ``evidence``,
    ``ablation``, ``parameter``, ``visual`` or ``conclusion``.  All that must name something
    are put into one relation and joined once with the evidence, names and ids, so each is
    shuffled once.
    """
    path = {
        "parameters": F.concat(F.lit("parameters."), F.col("pos")),
        "ablations": F.concat(F.lit("ablations."), F.col("pos")),
    }
    target = F.col("target")

    def facts(df: DataFrame, space: str, ref: str, shown: Column) -> DataFrame:
        return df.select("paper_id", F.lit(space).alias("_space"), F.col(ref).cast("string").alias("ref"), shown.alias("_shown"))

    def asking(refs: DataFrame, owner: str, *targets: str) -> DataFrame:
        space = F.when(target == "visual", "evidence").otherwise(target)
        return refs.where(target.isin(*targets)).select(
            "paper_id", path[owner].alias("_path"), "target", space.alias("_space"), F.col("ref").cast("string").alias("ref")
        )

    figure = F.coalesce(F.col("evidence_kind") != "text", F.lit(False))
    known = (
        facts(known_evidence(packet), "evidence", "evidence_id", figure)
        .unionByName(facts(parameters, "parameter", "name", F.lit(False)).distinct())
        .unionByName(facts(ablations, "ablation", "ablation_id", F.lit(False)).distinct())
    )
    asked = asking(parameter_refs, "parameters", "evidence", "ablation").unionByName(asking(ablation_refs, "ablations", "parameter", "visual"))
    found = asked.join(known, ["paper_id", "_space", "ref"], "left")
    unknown = F.col("_shown").isNull()
    # Null matches nothing here either, though a group may have it as its key.
    keyed = F.col("paper_id").isNotNull() & F.col("pos").isNotNull() & F.col("ref").isNotNull()
    uncited = (
        ablation_refs.where(target.isin("visual", "conclusion")).groupBy("paper_id", "pos", "ref")
        .agg(F.bool_or(target == "visual").alias("_visual"), F.bool_or(target == "conclusion").alias("_cited"))
        .where(F.col("_visual") & ~(F.col("_cited") & keyed)).select("paper_id", "pos").distinct()
    )
    parts = [
        row_issues(
            parameters,
            {"parameter_source_inference_mismatch": F.col("inferred") != (F.col("source_type") == INFERENCE)},
            field_path=path["parameters"],
        ),
        row_issues(duplicates(parameters, "paper_id", "name"),
                   {"duplicate_parameter_name": F.lit(True)}, field_path=F.lit("parameters")),
        row_issues(duplicates(ablations, "paper_id", "ablation_id"),
                   {"duplicate_ablation_id": F.lit(True)}, field_path=F.lit("ablations")),
        row_issues(
            found,
            {
                "parameter_unknown_evidence": (target == "evidence") & unknown,
                "parameter_unknown_ablation": (target == "ablation") & unknown,
                "ablation_unknown_parameter": (target == "parameter") & unknown,
                "ablation_requires_visual": (target == "visual") & ~F.coalesce("_shown", F.lit(False)),
            },
            evidence_id=F.col("ref"), field_path=F.col("_path"),
        ),
        row_issues(uncited, {"ablation_conclusion_missing_visual": F.lit(True)}, field_path=path["ablations"]),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _copies(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row per paper; which of several copies is kept does not matter, they are rejected."""
    return df.groupBy("paper_id").agg(
        F.count("*").alias(f"_{name}"), *[F.min(c).alias(c) for c in columns]
    )


def input_codes(
    selected: DataFrame, candidates: DataFrame, documents: DataFrame, packets: DataFrame, analyses: DataFrame
) -> DataFrame:
    """Why a selected paper cannot be validated: duplicate before candidate before input before document."""
    joined = (
        selected.select("paper_id").join(candidates.select("paper_id", F.lit(True).alias("_candidate")).distinct(), "paper_id", "left")
        .join(_copies(documents, "documents", "document_status"), "paper_id", "left")
        .join(_copies(packets, "packets"), "paper_id", "left")
        .join(_copies(analyses, "analyses"), "paper_id", "left")
    )
    c = F.col
    repeated = (c("_documents") > 1) | (c("_packets") > 1) | (c("_analyses") > 1)
    absent = c("_documents").isNull() | c("_packets").isNull() | c("_analyses").isNull()
    code = (
        F.when(F.coalesce(repeated, F.lit(False)) , "validation_duplicate_input")
        .when(c("_candidate").isNull(), "validation_candidate_missing")
        .when(absent, "validation_input_missing")
        .when(c("document_status").isin("failed", "skipped"), "validation_document_unavailable")
    )
    return joined.select(
        "paper_id", code.alias("code"),
        _unavailable_status(code).alias("status"),
    )


def batch_results(selected: DataFrame, codes: DataFrame, runs: DataFrame, reports: DataFrame) -> DataFrame:
    """The final code of every selected paper (paper_id, batch_id), with those of :func:`input_codes`.

    ``runs`` holds (batch_id, run_id), a row for each input that a batch was put together
    from: where these differ or one has no run id, no paper of the batch is validated.  A
    paper that nothing speaks against but that has no row in ``reports`` failed inside.
    """
    mixed = runs.groupBy("batch_id").agg(
        (F.bool_or(F.col("run_id").isNull()) | differs(F.min("run_id"), F.max("run_id"))).alias("_mixed")
    )
    joined = (
        selected.select("paper_id", "batch_id").join(codes.select("paper_id", F.col("code").alias("_code")), "paper_id", "left")
        .join(mixed.where("_mixed"), "batch_id", "left")
        .join(reports.select("paper_id", F.lit(True).alias("_report")).distinct(), "paper_id", "left")
    )
    code = (
        F.when(F.col("_mixed"), "validation_run_id_mismatch").when(F.col("_code").isNotNull(), F.col("_code"))
        .when(F.col("_report").isNull(), "validation_internal_error")
    )
    return joined.select("paper_id", code.alias("code")).select("*", _unavailable_status(F.col("code")).alias("status"))


def _unavailable_status(code: Column) -> Column:
    return F.when(code == "validation_input_missing", "skipped").when(code.isNotNull(), "failed")


def analysis_input_codes(selected: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Why a selected paper cannot be analysed; a document must come from the candidate's own address."""
    papers = candidates.select("paper_id", F.col("pdf_url").alias("_expected"))
    joined = selected.select("paper_id").join(papers, "paper_id", "left").join(
        documents.select("paper_id", "document_status", "source_url"), "paper_id", "left"
    )
    c = F.col
    code = (
        F.when(c("_expected").isNull(), "analysis_candidate_missing")
        .when(c("document_status").isNull(), "analysis_document_missing")
        .when(~c("document_status").isin("success", "partial"), "analysis_document_failed")
        .when(differs(c("source_url"), c("_expected")), "analysis_document_mismatch")
    )
    return joined.select("paper_id", code.alias("code"))


def provenance_issues(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text evidence that has no source block or differs from it."""
    source = blocks.select(
        "doc_id", "pos", F.col("text").alias("_text"), F.col("pdf_page").alias("_page"),
        F.col("section_pos").alias("_section"), F.lit(True).alias("_known"),
    )
    joined = evidence.join(source, ["doc_id", "pos"], "left")
    same = (
        (F.col("evidence_text") != "")
        & F.col("_text").startswith(F.col("evidence_text"))
        & F.col("pdf_page").eqNullSafe(F.col("_page"))
        & F.col("section_pos").eqNullSafe(F.col("_section"))
    )
    known = F.coalesce("_known", F.lit(False))
    return row_issues(
        joined,
        {"evidence_source_missing": ~known, "text_provenance_mismatch": known & ~same},
        paper_id="doc_id",
        field_path=F.concat(F.lit("evidence_candidates."), F.col("pos")),
    )


def regions_match(left: Column, right: Column) -> Column:
    """Same number of regions, equal one by one."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    return (F.size(left) == F.size(right)) & F.forall(same, lambda x: x)


def visual_provenance_issues(evidence: DataFrame, visuals: DataFrame) -> DataFrame:
    """Visual evidence without its source visual, or with other fields or regions."""
    fields = ("kind", "label", "caption", "section_pos", "confidence")
    source = visuals.select(
        "doc_id", "visual_id", F.lit(True).alias("_known"), F.col("regions").alias("_regions"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    joined = evidence.join(source, ["doc_id", "visual_id"], "left")
    same = regions_match(F.col("regions"), F.col("_regions"))
    for field in fields:
        same = same & F.col(field).eqNullSafe(F.col(f"_{field}"))
    known = F.coalesce("_known", F.lit(False))
    return row_issues(
        joined,
        {"evidence_source_missing": ~known, "visual_provenance_mismatch": known & ~F.coalesce(same, F.lit(False))},
        paper_id="doc_id",
        visual_id=F.col("visual_id"),
        field_path=F.concat(F.lit("evidence_candidates."), F.col("visual_id")),
    )


def evidence_id_issues(evidence: DataFrame, expected: Column) -> DataFrame:
    """Evidence whose id is not the one its source gives."""
    return row_issues(
        evidence, {"evidence_id_mismatch": differs(F.col("evidence_id"), expected)},
        paper_id="doc_id", evidence_id=F.col("evidence_id"), field_path=F.lit("evidence_candidates"),
    )


def fingerprint_issues(stated: DataFrame, computed: DataFrame) -> DataFrame:
    """Packets (doc_id, packet_fingerprint) whose stated fingerprint is not the computed one."""
    joined = stated.join(
        computed.select("doc_id", F.col("packet_fingerprint").alias("_computed")), "doc_id", "left"
    )
    return row_issues(
        joined, {"packet_fingerprint_mismatch": differs(F.col("packet_fingerprint"), F.col("_computed"))},
        paper_id="doc_id", field_path=F.lit("packet_fingerprint"),
    )


def section_hierarchy_issues(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, parent_id, title) whose ancestors loop or are missing."""
    def node(column):
        return F.concat_ws("/", F.col("doc_id").cast("string"), F.col(column).cast("string"))

    nodes = sections.select(
        node("section_id").alias("key"), F.when(F.col("parent_id").isNotNull(), node("parent_id")).alias("parent"), "title"
    )
    resolved = ancestor_paths(nodes, "key", "parent", "title")
    broken = resolved.where(F.col("status") != "ok").select(
        F.split_part("key", F.lit("/"), F.lit(1)).alias("doc_id"), F.split_part("key", F.lit("/"), F.lit(2)).alias("_section")
    )
    return row_issues(
        broken, {"section_hierarchy_invalid": F.lit(True)}, paper_id="doc_id",
        field_path=F.concat(F.lit("sections."), F.col("_section")),
    )


def enriched_visuals(drafts: DataFrame, packet: DataFrame) -> DataFrame:
    """Drafted visuals (paper_id, evidence_id, …) completed from their evidence; unknown references are marked."""
    source = packet.where("kind <> 'text'").select("paper_id", "evidence_id", "kind", "label", "pdf_page", "confidence")
    joined = drafts.join(source, ["paper_id", "evidence_id"], "left")
    return joined.withColumn(
        "failure", F.when(F.col("kind").isNull(), "supporting_visual_requires_figure_or_table")
    )


def modified_evidence(saved: DataFrame, packet: DataFrame, key: str) -> DataFrame:
    """Keys whose saved rows are not the packet's rows, counting repeats."""
    return saved.exceptAll(packet).select(key).union(packet.exceptAll(saved).select(key)).distinct()


def identity_issues(pairs: DataFrame) -> DataFrame:
    """Identity rules of an analysis joined to its candidate and document."""
    c = F.col
    return row_issues(
        pairs,
        {
            "paper_id_mismatch": differs(c("analysis_paper_id"), c("paper_id")),
            "candidate_title_mismatch": differs(c("english_title"), c("title")),
            "candidate_link_mismatch": differs(c("analysis_pdf_url"), c("pdf_url"))
            | differs(c("analysis_code_url"), c("code_url")),
            "packet_document_mismatch": differs(c("packet_document"), c("document_fingerprint"))
            | differs(c("source_url"), c("pdf_url")),
        },
    )


