import json

from pyspark.sql import functions as F

from lectern.operators import answers, constraints, dedup, validation

CLAIM = "paper_id string, claim_pos long, claim_id string, kind string, expected_kind string, source_type string, inferred boolean"


def _claim(pos, claim_id="", kind="insight", expected=None, source="paper_text", inferred=False):
    return ("p", pos, claim_id or f"c{pos}", kind, expected or kind, source, inferred)


def _checked(spark, claims, edges, packet):
    c = spark.createDataFrame(claims, CLAIM)
    e = spark.createDataFrame([("p", *x) for x in edges], "paper_id string, claim_pos long, evidence_id string")
    k = spark.createDataFrame([("p", *x) for x in packet], "paper_id string, evidence_id string, kind string, abstract_only boolean, pos long")
    facts = validation.claim_facts(c, e, k)
    return c, facts, validation.claim_issues(facts, e, k)


PACKET = [("full", "text", False, 0), ("abs", "text", True, 1), ("twice", "text", False, 2), ("twice", "text", False, 3)]


def test_each_claim_rule(spark):
    claims = [_claim(0), _claim(1), _claim(2, kind="method", expected="result"), _claim(3, kind="method", inferred=True),
              _claim(4, kind="method"), _claim(5, "same", "method"), _claim(6, "same", "method"), _claim(7, kind="method"), _claim(8)]
    edges = [(0, "full"), (1, "abs"), (2, "full"), (3, "full"), (4, "nowhere"), (5, "full"), (6, "full"), (7, "full"), (7, "full")]
    _, facts, issues = _checked(spark, claims, edges, PACKET)
    got = {(r.code, r.claim_id or r.evidence_id) for r in issues.collect()}
    assert got == {
        ("abstract_only_insight", "c1"), ("abstract_only_insight", "c8"), ("claim_kind_mismatch", "c2"),
        ("claim_source_inference_mismatch", "c3"), ("unknown_evidence", "nowhere"), ("duplicate_claim_id", "same"),
        ("duplicate_claim_evidence_id", "c7"), ("duplicate_evidence_id", "twice"),
    }
    verdicts = {r.claim_id: r for r in validation.claim_verdicts(facts).collect()}
    assert len(verdicts) == 8
    assert verdicts["c0"].status == "valid" and verdicts["c0"].resolved_count == 1
    assert verdicts["c4"].issue_codes == ["unknown_evidence"] and verdicts["c4"].resolved_count == 0
    assert verdicts["same"].issue_codes == ["duplicate_claim_id"] and verdicts["same"].claim_pos == 5


def test_report_status_and_publication(spark):
    papers = spark.createDataFrame([("a", "success"), ("b", "success"), ("c", "partial"), ("d", "failed"), ("e", "success"), ("f", "skipped")],
                                   "paper_id string, analysis_status string")
    issues = spark.createDataFrame([("x", "error", "b"), ("core_insight_missing", "warning", "e")], "code string, severity string, paper_id string")
    reports = validation.report_status(papers, issues)
    got = {r.paper_id: (r.result_status, r.publication_eligibility) for r in reports.collect()}
    assert got == {"a": ("validated", "eligible"), "b": ("invalid", "blocked"), "c": ("partial", "blocked"),
                   "d": ("failed", "blocked"), "e": ("partial", "blocked"), "f": ("skipped", "blocked")}
    for allow, expected in ((True, "partial"), (False, "excluded")):
        decided = {r.paper_id: r.decision for r in validation.publication(reports, allow).collect()}
        assert decided["a"] == "full" and decided["c"] == expected and decided["b"] == "excluded"


def test_missing_insight_is_a_warning(spark):
    claims = spark.createDataFrame([_claim(0, kind="method")], CLAIM)
    assert [(r.code, r.severity) for r in validation.missing_insight(claims).collect()] == [("core_insight_missing", "warning")]


def test_visual_rules(spark):
    packet = spark.createDataFrame([("p", "f1", "figure", "Figure 1", 2, 0), ("p", "t1", "text", None, 1, 1)],
                                   "paper_id string, evidence_id string, kind string, label string, pdf_page long, pos long")
    claims = spark.createDataFrame([_claim(0)], CLAIM)
    rows = [(1, "f1", 0, "figure", "Figure 1", 2, "support", True), (2, "t1", 0, "text", None, 1, "support", True),
            (3, "f1", 9, "figure", "Figure 1", 2, "support", True), (4, "f1", 0, "table", "Figure 1", 2, "support", True),
            (5, "f1", 0, "figure", "Figure 1", 2, "result", True)]
    visuals = spark.createDataFrame([("p", *r) for r in rows], "paper_id string, pos long, evidence_id string, insight_pos long, kind string, "
                                    "label string, pdf_page long, explanation_kind string, explanation_cites boolean")
    got = {(r.code, r.field_path) for r in validation.visual_issues(visuals, claims, packet).collect()}
    assert got == {
        ("supporting_visual_requires_figure_or_table", "supporting_visuals.2"), ("supporting_visual_unknown_insight", "supporting_visuals.3"),
        ("supporting_visual_provenance_mismatch", "supporting_visuals.4"), ("invalid_support_explanation", "supporting_visuals.5"),
        ("too_many_supporting_visuals", "supporting_visuals"),
    }


def test_parameter_rules(spark):
    packet = spark.createDataFrame([("p", "e1", "text", False, 0), ("p", "f1", "figure", False, 1)],
                                   "paper_id string, evidence_id string, kind string, abstract_only boolean, pos long")
    parameters = spark.createDataFrame([("p", 0, "lr", "paper_text", False), ("p", 1, "lr", "paper_text", True)],
                                       "paper_id string, pos long, name string, source_type string, inferred boolean")
    ablations = spark.createDataFrame([("p", 0, "a1"), ("p", 1, "a1"), ("p", 2, "a2")], "paper_id string, pos long, ablation_id string")
    refs = "paper_id string, pos long, target string, ref string"
    parameter_refs = spark.createDataFrame([("p", 0, "evidence", "e1"), ("p", 0, "evidence", "e9"), ("p", 0, "ablation", "a9")], refs)
    ablation_refs = spark.createDataFrame(
        [("p", 0, "parameter", "wd"), ("p", 0, "visual", "e1"), ("p", 0, "conclusion", "e1"), ("p", 2, "visual", "f1")], refs)
    got = {r.code for r in validation.parameter_issues(parameters, parameter_refs, ablations, ablation_refs, packet).collect()}
    assert got == {
        "parameter_source_inference_mismatch", "duplicate_parameter_name", "duplicate_ablation_id", "parameter_unknown_evidence",
        "parameter_unknown_ablation", "ablation_unknown_parameter", "ablation_requires_visual", "ablation_conclusion_missing_visual",
    }


def _parameter_inputs(spark):
    packet = spark.createDataFrame([("p", "e1", "text", False, 0), ("p", "e1", "figure", False, 1), ("p", None, "figure", False, 2), ("p", "n1", None, False, 3)],
                                   "paper_id string, evidence_id string, kind string, abstract_only boolean, pos long")
    parameters = spark.createDataFrame([("p", 0, "lr", "paper_text", False), ("p", 1, None, "paper_text", False)],
                                       "paper_id string, pos long, name string, source_type string, inferred boolean")
    ablations = spark.createDataFrame([("p", 0, "a1"), ("p", 1, "e1")], "paper_id string, pos long, ablation_id string")
    refs = "paper_id string, pos long, target string, ref string"
    parameter_refs = spark.createDataFrame(
        [("p", 0, "evidence", "e1"), ("p", 0, "evidence", "lr"), ("p", 1, "evidence", "lr"), ("p", 1, "evidence", None), ("p", 0, "ablation", "e1"),
         ("p", 0, "ablation", "lr"), ("p", 0, "visual", "e9"), (None, 0, "evidence", "e1")], refs)
    ablation_refs = spark.createDataFrame(
        [("p", 0, "parameter", "a1"), ("p", 0, "parameter", "a1"), ("p", 0, "parameter", "lr"), ("p", 0, "parameter", None), ("p", 0, "visual", "e1"), ("p", 0, "conclusion", "e1"),
         ("p", 1, "visual", "n1"), ("p", 1, "conclusion", "n1"), ("p", 2, "visual", None), ("p", 2, "conclusion", None), ("p", 3, "visual", "e1"), ("p", 3, "visual", "e1")], refs)
    return parameters, parameter_refs, ablations, ablation_refs, packet


def test_parameter_rules_on_nulls_copies_and_ids_shared_between_kinds(spark):
    found = validation.parameter_issues(*_parameter_inputs(spark))
    got = sorted((r.code, r.paper_id or "", r.field_path, r.evidence_id or "") for r in found.collect())
    assert got == sorted([
        ("parameter_unknown_evidence", "p", "parameters.0", "lr"), ("parameter_unknown_evidence", "p", "parameters.1", "lr"),
        ("parameter_unknown_evidence", "p", "parameters.1", ""), ("parameter_unknown_evidence", "", "parameters.0", "e1"),
        ("parameter_unknown_ablation", "p", "parameters.0", "lr"), *[("ablation_unknown_parameter", "p", "ablations.0", "a1")] * 2,
        ("ablation_unknown_parameter", "p", "ablations.0", ""), ("ablation_requires_visual", "p", "ablations.1", "n1"),
        ("ablation_requires_visual", "p", "ablations.2", ""), ("ablation_conclusion_missing_visual", "p", "ablations.2", ""),
        ("ablation_conclusion_missing_visual", "p", "ablations.3", ""),
    ])


def test_parameter_rules_join_the_references_once(spark):
    plan = validation.parameter_issues(*_parameter_inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_references_of_repeated_orders_count_once_per_pair(spark, tmp_path):
    from datetime import datetime

    from lectern.plans import validation_plans

    day = datetime(1995, 3, 31, 12)
    orders = [(1, 7, "3-M"), (1, 7, "3-M"), (1, 7, "2-H"), (1, 8, "1-U"), (2, None, "3-M"), (None, 7, "3-M"), (3, 7, "2-H")]
    spark.createDataFrame([(*o, day, "O", 1.0) for o in orders], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp, o_orderstatus string, "
                          "o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 0.01), (2, 5, 0.01), (None, 5, 0.01), (3, 5, 0.09), (3, None, 0.01), (4, 5, 0.01)]
    spark.createDataFrame([(*x, day) for x in lines], "l_orderkey long, l_partkey long, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [sorted((*r[:3], r[3] or "") for r in refs.collect()) for refs in validation_plans._parameter_refs(spark, str(tmp_path))]
    # Three rows of order 1 have customer 7: two parameters and one ablation, each with the line three times.
    of_three = [(7, 3, "parameter", "c199503"), (7, 3, "visual", "5"), (7, 3, "parameter", "c199503"), (7, 3, "visual", ""), (7, 3, "conclusion", "")]
    assert got[0] == sorted([(7, 1, "evidence", "5"), (7, 1, "ablation", "c199503")] * 6)
    assert got[1] == sorted([(7, 1, "parameter", "c199503"), (7, 1, "visual", "5"), (7, 1, "conclusion", "5")] * 3 + of_three)


def test_input_codes_follow_their_precedence(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    ids = [(k,) for k in "abcdefg"]
    selected = frame(ids, "paper_id string")
    candidates = frame([(k,) for k in "acdefg"], "paper_id string")
    documents = frame([("a", "success"), ("a", "success"), ("b", "success"), ("d", "failed"), ("e", "success"), ("f", "success")],
                      "paper_id string, document_status string")
    packets = frame([(k,) for k in "abdeff"], "paper_id string")
    analyses = frame([(k,) for k in "abdef"], "paper_id string")
    got = {r.paper_id: (r.code, r.status) for r in validation.input_codes(selected, candidates, documents, packets, analyses).collect()}
    assert got == {
        "a": ("validation_duplicate_input", "failed"), "b": ("validation_candidate_missing", "failed"),
        "c": ("validation_input_missing", "skipped"), "d": ("validation_document_unavailable", "failed"), "e": (None, None),
        "f": ("validation_duplicate_input", "failed"), "g": ("validation_input_missing", "skipped"),
    }


def test_candidate_rules(spark):
    from datetime import datetime

    day = datetime(2024, 1, 2)
    rows = [("arxiv:2401.00001", "2401.00001", ["a"], "a", day, day, ["x"]), ("x", "2401.00002", ["a"], "a", day, day, ["x"]),
            ("arxiv:2401.00003v2", "2401.00003v2", ["a"], "a", day, day, ["x"]), ("arxiv:2401.00004", "2401.00004", ["a"], "b", day, day, ["x"]),
            ("arxiv:2401.00005", "2401.00005", ["a"], "a", day, datetime(2024, 1, 1), ["x"]), ("arxiv:2401.00006", "2401.00006", ["a"], "a", day, day, [])]
    df = spark.createDataFrame(rows, "paper_id string, arxiv_id string, categories array<string>, primary_category string, "
                               "published_at timestamp, updated_at timestamp, authors array<string>")
    codes = sorted(r.code for r in constraints.candidate_issues(df).collect())
    assert codes == ["arxiv_id_not_base", "authors_empty", "paper_id_not_derived", "primary_category_missing", "updated_before_published"]


def _analysis(**fields):
    claim = {"claim_id": "c1", "kind": "insight", "text": "t", "source_type": "paper_text", "inferred": False, "evidence_ids": ["e"], "confidence": 0.5}
    return json.dumps({"paper_id": "p", "english_title": "T", "insights": [claim], **fields}), claim


def test_answers_are_parsed_filled_and_located(spark):
    text, claim = _analysis(chinese_title={"claim_id": "t", "kind": "title", "evidence_ids": []})
    rich, _ = _analysis(parameters=[{"name": "lr", "role": {**claim, "claim_id": "r"}}],
                        supporting_visuals=[{"evidence_id": "e", "support_explanation": {**claim, "claim_id": "s"}}], limitations=None)
    rows = [("a", "﻿```json\n" + text + "\n```"), ("b", rich), ("c", text + "}"), ("d", text + text), ("e", "no"), ("f", '{"insights": []}'), ("g", "```\n" + text + "\n```")]
    parsed = answers.parse(spark.createDataFrame(rows, "k string, answer string"), "answer")
    failures = {r.k: r.failure for r in parsed.select("k", "failure").collect()}
    assert failures == {"a": None, "b": None, "c": "analysis_malformed_json", "d": "analysis_malformed_json",
                        "e": "analysis_malformed_json", "f": "analysis_schema_invalid", "g": None}
    located = {(r.k, r.field_path, r.expected_kind, r.claim_id) for r in answers.claim_locations(parsed, "k").collect()}
    assert {x[1:] for x in located if x[0] == "a"} == {("chinese_title", "title", "t"), ("insights.0", "insight", "c1")}
    assert {x[1:] for x in located if x[0] == "b"} == {
        ("insights.0", "insight", "c1"), ("supporting_visuals.0.support_explanation", "support", "s"), ("parameters.0.role", "parameter", "r")}
    gaps = {r.missing_field for r in answers.coverage_gaps(parsed.where("k = 'b'"), "k").collect()}
    assert gaps == {"recommendation", "research-problem", "ablations", "limitations"}


def test_latest_version_and_fingerprint(spark):
    rows = [("x", 1, 5, "old"), ("x", 2, 1, "new"), ("y", 1, 1, "a"), ("y", 1, 2, "b")]
    df = spark.createDataFrame(rows, "id string, version int, updated int, v string")
    got = dedup.latest_version(df, ["id"], [F.col("version"), F.col("updated")]).collect()
    assert {r.id: r.v for r in got} == {"x": "new", "y": "b"}

    def mark(frame):
        return dedup.set_fingerprint(frame.select(F.sha2("v", 256).alias("d")), F.col("d")).first().fingerprint

    assert mark(df) == mark(df.orderBy(F.desc("v")).repartition(3))
    assert mark(df) != mark(df.unionByName(df.limit(1))) and mark(df) != mark(df.where("v <> 'a'"))


def test_provenance_and_identity_rules(spark):
    region = "array<struct<pdf_page: long>>"
    schema = f"doc_id long, visual_id long, kind string, label string, caption string, section_pos long, confidence double, regions {region}"
    base = (1, 1, "figure", "Figure 1", "c", 3, 0.9, [(1,), (2,)])
    visuals = spark.createDataFrame([base, (1, 2, *base[2:]), (1, 3, *base[2:]), (1, 4, *base[2:])], schema)
    stated = spark.createDataFrame([base, (1, 2, "table", *base[3:]), (1, 3, *base[2:7], [(2,), (1,)]), (1, 4, *base[2:7], [(1,)]), (1, 9, *base[2:])], schema)
    got = {(r.code, r.visual_id) for r in validation.visual_provenance_issues(stated, visuals).collect()}
    assert got == {("visual_provenance_mismatch", "2"), ("visual_provenance_mismatch", "3"), ("visual_provenance_mismatch", "4"), ("evidence_source_missing", "9")}
    blocks = spark.createDataFrame([(1, 1, "whole text", 1, 5)], "doc_id long, pos long, text string, pdf_page long, section_pos long")
    rows = [(1, 1, "whole", 1, 5), (1, 1, "other", 1, 5), (1, 1, "", 1, 5), (1, 1, "whole", 2, 5), (1, 1, "whole", 1, None), (1, 2, "whole", 1, 5)]
    evidence = spark.createDataFrame(rows, "doc_id long, pos long, evidence_text string, pdf_page long, section_pos long")
    codes = [r.code for r in validation.provenance_issues(evidence, blocks).collect()]
    assert codes.count("text_provenance_mismatch") == 4 and codes.count("evidence_source_missing") == 1
    pair = ("p", "p", "T", "T", "u", "u", None, None, "f", "f", "u")
    names = ("paper_id, analysis_paper_id, title, english_title, pdf_url, analysis_pdf_url, code_url, analysis_code_url, "
             "document_fingerprint, packet_document, source_url").replace(",", " string,") + " string"
    broken = [pair, ("q", *pair[1:]), (*pair[:3], "t", *pair[4:]), (*pair[:7], "x", *pair[8:]), (*pair[:9], "g", *pair[10:]), (*pair[:10], "v")]
    codes = sorted(r.code for r in validation.identity_issues(spark.createDataFrame(broken, names)).collect())
    assert codes == ["candidate_link_mismatch", "candidate_title_mismatch", "packet_document_mismatch", "packet_document_mismatch", "paper_id_mismatch"]
    sections = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 1, "b"), (2, 2, 1, "c"), (3, 1, 2, "d"), (3, 2, 1, "e")],
                                     "doc_id long, section_id long, parent_id long, title string")
    got = {(r.paper_id, r.field_path) for r in validation.section_hierarchy_issues(sections).collect()}
    assert got == {("2", "sections.2"), ("3", "sections.1"), ("3", "sections.2")}
    drafts = spark.createDataFrame([("p", "f"), ("p", "t"), ("p", "x")], "paper_id string, evidence_id string")
    packet = spark.createDataFrame([("p", "f", "figure", "Figure 1", 2, 0.5), ("p", "t", "text", None, 1, 0.5)],
                                   "paper_id string, evidence_id string, kind string, label string, pdf_page long, confidence double")
    rows = {r.evidence_id: (r.label, r.failure) for r in validation.enriched_visuals(drafts, packet).collect()}
    code = "supporting_visual_requires_figure_or_table"
    assert rows == {"f": ("Figure 1", None), "t": (None, code), "x": (None, code)}
