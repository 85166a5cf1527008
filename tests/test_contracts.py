import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import answers, contracts, ranking, reader, validation
from lectern.plans import contract_plans

ORDER = ("fetch", "read", "send")
LIMITS = contracts.BatchLimits(pool=4, shortlist=3, full=1)


def _batches(spark, changes):
    """One sound batch of four papers per run, with the given lists put in place of its own."""
    candidates, rankings, selections = [], [], []
    for run, change in changes.items():
        ids = change.get("ids", ["a", "b", "c", "d"])
        ranked = change.get("ranked", ids)
        candidates += [(run, i + change.get("shift", 1), p) for i, p in enumerate(ids)]
        rankings += [
            (run, i + 1, p, change.get("ranks", range(1, 9))[i], change.get("scores", [None] * 9)[i]) for i, p in enumerate(ranked)
        ]
        for kind, n in (("shortlist", 3), ("full", 1)):
            selections += [(run, kind, i + 1, p) for i, p in enumerate(change.get(kind, ids[:n]))]
    issues = contracts.batch_issues(
        spark.createDataFrame(candidates, "run_id string, pos long, paper_id string"),
        spark.createDataFrame(rankings, "run_id string, pos long, paper_id string, rank long, llm_score double"),
        spark.createDataFrame(selections, "run_id string, kind string, pos long, paper_id string"),
        LIMITS,
    )
    return {(r.paper_id, r.code) for r in issues.collect()}


def test_batches(spark):
    found = _batches(spark, {
        "sound": {},
        "short": {"ids": ["a", "b"]},
        "over": {"ids": list("abcde")},
        "twice": {"ids": ["a", "a", "c"]},
        "moved": {"ranked": ["b", "a", "c", "d"]},
        "lacking": {"ranked": ["a", "b", "c"]},
        "ranks": {"ranks": [1, 2, 2, 4]},
        "none": {"ranks": [1, None, 3, 4]},
        "list": {"shortlist": ["a", "c", "b"]},
        "less": {"shortlist": ["a", "b"]},
        "more": {"full": ["a", "b"]},
        "scored": {"scores": [None, 1.0, None, None]},
    })
    assert found == {
        ("over", "candidates_over_pool"), ("twice", "candidate_id_not_unique"), ("moved", "ranking_not_in_candidate_order"),
        ("lacking", "ranking_not_in_candidate_order"), ("ranks", "rank_not_consecutive"), ("none", "rank_not_consecutive"),
        ("list", "shortlist_not_prefix"), ("less", "shortlist_not_prefix"), ("more", "full_analysis_not_prefix"),
        ("scored", "llm_score_before_its_stage"),
    }
    assert ("late", "candidate_place_missing") in _batches(spark, {"late": {"shift": 2}})


def test_empty_batches(spark):
    assert _batches(spark, {}) == set()


def _manifest_codes(spark, run="r", stages=None, **claims):
    sound = [("fetch", "success", 1, 0, 0), ("read", "partial", 0, 2, 1), ("send", "success", 0, 0, 0)]
    stage_rows = [(run, i + 1, *s) for i, s in enumerate(sound if stages is None else stages)]
    manifest = {
        "run_id": run, "status": "partial", "started_at": datetime(2024, 1, 1), "completed_at": datetime(2024, 1, 2), "dry_run": False,
        "send_requested": True, "cache_hit_count": 1, "retry_count": 2, "partial_failure_count": 1, "published_count": 3,
        "delivered_count": 2, "artifact_hash": "h", "site_published_count": 3, "site_artifact_hash": "h", "delivery_status": "sent", "delivery_count": 2,
    } | claims
    counters = "cache_hit_count long, retry_count long, partial_failure_count long"
    schema = (
        f"run_id string, status string, started_at timestamp, completed_at timestamp, dry_run boolean, send_requested boolean, {counters}, "
        "published_count long, delivered_count long, artifact_hash string, site_published_count long, site_artifact_hash string, "
        "delivery_status string, delivery_count long"
    )
    issues = contracts.manifest_issues(
        spark.createDataFrame([tuple(manifest.values())], schema),
        spark.createDataFrame(stage_rows, f"run_id string, pos long, stage string, status string, {counters}"), ORDER,
    )
    return sorted(r.code for r in issues.collect())


@pytest.mark.parametrize(
    "claims, codes",
    [
        ({}, []),
        ({"completed_at": datetime(2023, 1, 1)}, ["completed_before_started"]),
        ({"dry_run": True}, ["dry_run_requests_sending", "sent_without_request"]),
        ({"send_requested": False}, ["sent_without_request"]),
        ({"send_requested": False, "delivery_status": "skipped"}, []),
        ({"cache_hit_count": 2, "retry_count": None}, ["cache_hit_count_total_mismatch", "retry_count_total_mismatch"]),
        ({"partial_failure_count": 0}, ["partial_failure_count_total_mismatch"]),
        ({"site_published_count": 2, "delivery_count": 1}, ["delivered_count_mismatch", "published_count_mismatch"]),
        ({"site_artifact_hash": None}, ["artifact_hash_mismatch"]),
        ({"status": "success"}, ["run_status_not_derived"]),
    ],
)
def test_manifest(spark, claims, codes):
    assert _manifest_codes(spark, **claims) == codes


@pytest.mark.parametrize(
    "statuses, derived",
    [
        (("success", "success", "success"), "success"), (("empty", "failed", "skipped"), "empty"), (("success", "failed", "success"), "failed"),
        (("success", "success", "failed"), "partial"), (("success", "partial", "success"), "partial"),
    ],
)
def test_status_follows_from_stages(spark, statuses, derived):
    stages = [(name, status, 0, 0, 0) for name, status in zip(ORDER, statuses)]
    none = {"cache_hit_count": 0, "retry_count": 0, "partial_failure_count": 0}
    assert _manifest_codes(spark, stages=stages, status=derived, **none) == []


def test_stages_in_another_order(spark):
    one = lambda name: (name, "success", 0, 0, 0)
    none = {"cache_hit_count": 0, "retry_count": 0, "partial_failure_count": 0, "status": "success"}
    for names in (("read", "fetch", "send"), ("fetch", "read"), ("fetch", "read", "read"), ("fetch", "read", "send", "send"), ("fetch", None, "send")):
        assert _manifest_codes(spark, stages=[one(n) for n in names], **none) == ["stages_out_of_order"]
    assert "stages_out_of_order" in _manifest_codes(spark, stages=[], **none)


def _claim(**changes):
    return {"claim_id": "c", "kind": "insight", "text": "t", "source_type": "paper_text", "inferred": False, "evidence_ids": ["e"], "confidence": 0.5} | changes


def _parameter(**changes):
    return {"name": "n", "role": _claim(kind="parameter"), "evidence_ids": [], "ablation_ids": [], "source_type": "system_inference", "inferred": True, "confidence": 1} | changes


def _answer_codes(spark, **fields):
    given = json.dumps({"paper_id": "p", "english_title": "t"} | fields)
    parsed = answers.parse(spark.createDataFrame([("p", given)], "paper_id string, answer string"), "answer")
    return sorted((r.field_path, r.code) for r in contracts.answer_issues(parsed).collect())


@pytest.mark.parametrize(
    "fields, found",
    [
        ({"insights": [_claim()], "parameters": [_parameter()]}, []),
        ({"insights": [_claim(), _claim(claim_id=" ", text=None)]}, [("insights.1", "claim_id_blank"), ("insights.1", "claim_text_blank")]),
        ({"research_problem": _claim()}, [("research_problem", "claim_kind_mismatch")]),
        ({"limitations": [_claim(kind="limitation", evidence_ids=["e", "e"])]}, [("limitations.0", "claim_evidence_repeated")]),
        ({"insights": [_claim(inferred=True), _claim(source_type="system_inference")]}, [("insights.0", "claim_origin_mismatch"), ("insights.1", "claim_origin_mismatch")]),
        ({"insights": [_claim(confidence=1.5), _claim(confidence=None)]}, [("insights.0", "confidence_out_of_range"), ("insights.1", "confidence_out_of_range")]),
        ({"parameters": [_parameter(name="", role=None)]}, [("parameters.0.role", "claim_missing"), ("parameters.0.role", "parameter_name_blank")]),
        ({"parameters": [_parameter(ablation_ids=["a", "a"])]}, [("parameters.0.role", "parameter_references_repeated")]),
        ({"parameters": [_parameter(inferred=False, confidence=-1)]}, [("parameters.0.role", "parameter_confidence_out_of_range"), ("parameters.0.role", "parameter_origin_mismatch")]),
        ({"ablations": [{"ablation_id": "\t", "conclusion": _claim(kind="ablation")}]}, [("ablations.0.conclusion", "ablation_id_blank"), ("ablations.0.conclusion", "ablation_without_visual")]),
        ({"method_modules": [{"name": " ", "purpose": _claim(kind="method")}]}, [("method_modules.0.purpose", "module_name_blank")]),
        ({"supporting_visuals": [{"evidence_id": "x", "insight_ids": [], "support_explanation": _claim(kind="support")}]},
         [("supporting_visuals.0.support_explanation", "visual_not_cited"), ("supporting_visuals.0.support_explanation", "visual_without_insight")]),
    ],
)
def test_answers(spark, fields, found):
    assert _answer_codes(spark, **fields) == found


def test_broken_answers_give_nothing(spark):
    rows = spark.createDataFrame([("p", "{"), ("q", None)], "paper_id string, answer string")
    assert contracts.answer_issues(answers.parse(rows, "answer")).count() == 0


def test_reader_switches(spark):
    cards = spark.createDataFrame([("p1", "The Cat"), ("p2", "a dog"), ("p3", None)], "paper_id string, title string")
    state = spark.createDataFrame([("p1", True, False, True), ("p2", False, True, False)], "paper_id string, read boolean, favorite boolean, irrelevant boolean")
    rows = reader.with_state(cards, state)

    def shown(*switches):
        return [r.paper_id for r in rows.where(reader.visible(F.concat_ws(" ", "paper_id", "title"), *switches)).orderBy("paper_id").collect()]

    assert shown() == ["p2", "p3"]
    assert shown("", True) == ["p1", "p2", "p3"]
    assert shown(" CAT ", True) == ["p1"]
    assert shown("P3") == ["p3"]
    assert shown("", True, True) == ["p2", "p3"]
    assert shown("", False, False, True) == ["p2"]


def test_scorers_by_name(spark):
    assert ranking.scorer("recency") is ranking.recency_scores
    with pytest.raises(ValueError, match="not registered; known: .*mean"):
        ranking.scorer("none")


def test_batches_of_different_runs_are_not_validated(spark):
    selected = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)], "paper_id string, batch_id long")
    codes = spark.createDataFrame(
        [("a", None), ("b", None), ("c", None), ("d", "validation_input_missing"), ("e", None)], "paper_id string, code string"
    )
    runs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, "x"), (3, None)], "batch_id long, run_id string")
    reports = spark.createDataFrame([("a",), ("a",)], "paper_id string")
    got = {r.paper_id: (r.code, r.status) for r in validation.batch_results(selected, codes, runs, reports).collect()}
    mixed = ("validation_run_id_mismatch", "failed")
    assert got == {"a": mixed, "b": mixed, "e": mixed, "c": ("validation_internal_error", "failed"), "d": ("validation_input_missing", "skipped")}


def test_a_batch_is_numbered_once_for_all_its_parts(spark, tmp_path, capsys):
    rows = [(k, k % 3, date(2024, 1, 1 + k % 9)) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    issues = contract_plans.batch_contract(spark, str(tmp_path))
    issues.explain()
    assert "Window" not in capsys.readouterr().out
    # Twenty orders each: over the pool, and with repeated dates.
    codes = {(r.run_id, r.code) for r in issues.collect()}
    assert {(run, code) for run in range(3) for code in ("candidates_over_pool", "candidate_id_not_unique")} <= codes
