import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import models
from lectern.operators import evidence, feedback
from lectern.operators.result_store import ResultStore
from lectern.plans import daily
from lectern.sources import feeds

FIXTURE = {
    "collections": [
        {"key": "root", "name": "Library", "parent_key": None}, {"key": "seed", "name": "Seeds", "parent_key": "root"},
        {"key": "vision", "name": "Vision", "parent_key": "seed"}, {"key": "old", "name": "Archive", "parent_key": "root"}],
    "items": [
        {"key": "I1", "title": "nets", "abstract": "one", "collection_keys": ["vision"], "added_at": "2024-01-02T00:00:00Z"},
        {"key": "I2", "title": "nets", "abstract": "two", "collection_keys": ["vision", "old"], "added_at": "2024-01-01T00:00:00Z"},
        {"key": "I3", "title": " ", "abstract": "x", "collection_keys": ["vision"], "added_at": "2024-01-01T00:00:00Z"},
        {"key": "I4", "title": "a", "abstract": "x", "collection_keys": ["gone"], "added_at": "2024-01-01T00:00:00Z"},
        {"key": "I5", "title": "a", "abstract": "x", "collection_keys": [], "added_at": "2024-01-01T00:00:00Z"}],
    "arxiv_entries": [
        {"arxiv_id": f"2401.0000{k}", "version": v, "title": f"t{k}", "authors": ["A"], "abstract": f"v{v}", "categories": [c], "primary_category": c,
         "published_at": "2024-01-02T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z", "arxiv_url": "u", "pdf_url": f"p{k}", "code_url": None}
        for k, v, c in ((1, 1, "cs.CV"), (1, 2, "cs.CV"), (2, 1, "cs.CV"), (3, 1, "cs.CL"), (4, 1, "cs.CV"))],
    "embeddings": {
        "nets\n\none": [1.0, 0.0], "t1\n\nv2": [0.9, 0.1], "t2\n\nv1": [0.1, 0.9], "t4\n\nv1": [1.0, 0.0], "focus": [0.0, 1.0]},
    "now": "2024-01-03T00:00:00Z",
}
SETTINGS = daily.RunSettings("r1", ("Library/Seeds/**",), ("Library/Archive",), ("cs.CV",))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("fixture") / "offline.json"
    path.write_text(json.dumps(FIXTURE, indent=1))
    return feeds.read_offline_fixture(spark, str(path))


def _entries(tables):
    return tables["arxiv_entries"].withColumn("paper_id", F.concat(F.lit("arxiv:"), "arxiv_id"))


def _embed(tables):
    return lambda df: models.from_table(df, tables["embeddings"], "text", "embedding")


def test_interest_corpus(tables):
    corpus = daily.interest_corpus(tables["collections"], tables["items"], SETTINGS)
    got = {r.paper_id: r.verdict for r in corpus.collect()}
    assert got == {"zotero:I1": "eligible", "zotero:I2": "excluded", "zotero:I3": "invalid", "zotero:I4": "invalid", "zotero:I5": "excluded"}
    assert daily.corpus_fingerprint(corpus).first().rows == 5


def test_candidates_with_feedback_and_focus(spark, tables):
    corpus = daily.interest_corpus(tables["collections"], tables["items"], SETTINGS)
    plain = daily.candidate_batch(corpus, _entries(tables),
                                  _embed(tables), None, SETTINGS).orderBy("rank").collect()
    assert [(r.paper_id, r.version) for r in plain] == [("arxiv:2401.00004", 1), ("arxiv:2401.00001", 2), ("arxiv:2401.00002", 1)]
    commands = spark.createDataFrame(
        [("a", "2401.00004", "set_irrelevant", True, 1), ("b", "2401.00002", "set_favorite", True, 2)],
        "command_id string, paper_id string, action string, value boolean, sequence long",
    ).selectExpr("*", "timestamp'2024-01-01' AS occurred_at", "'d' AS device_id")
    focused = daily.RunSettings("r1", ("Library/Seeds/**",), ("Library/Archive",), ("cs.CV",), focus_query="focus", focus_weight=0.6)
    rows = daily.candidate_batch(
        corpus, _entries(tables),
        _embed(tables), feedback.replay(commands), focused).orderBy("rank").collect()
    assert [r.paper_id for r in rows] == ["arxiv:2401.00002", "arxiv:2401.00001"]
    assert rows[0].feedback_adjustment == pytest.approx(0.05)
    batch = spark.createDataFrame([(r.paper_id,) for r in rows], "paper_id string")
    assert [r.paper_id for r in daily.ordered_selection(batch, ["arxiv:2401.00001", "arxiv:2401.00002"]).collect()] == ["arxiv:2401.00001", "arxiv:2401.00002"]
    with pytest.raises(Exception, match="unknown paper id"):
        daily.ordered_selection(batch, ["nope"]).collect()


def test_packets_to_reports(spark):
    items = spark.createDataFrame(
        [(1, 0, "1 Introduction", "section_header", 1, 1), (1, 1, "Claims need proof.", "text", 1, 1), (1, 2, "", "picture", 1, 1),
         (1, 3, "Figure 1: proof", "caption", 1, 1), (1, 4, "Abstract", "title", 1, 1), (1, 5, "Short.", "text", 1, 1)],
        "doc_id long, pos long, text string, label string, level int, pdf_page long",
    ).selectExpr("*", "double(10) AS raw_left", "double(10 + 20 * pos) AS raw_top", "double(90) AS raw_right",
                 "double(20 + 20 * pos) AS raw_bottom", "'top_left' AS origin",
                 "CASE WHEN label = 'picture' THEN array(bigint(3)) ELSE array() END AS caption_refs")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0)], "doc_id long, pdf_page long, width double, height double")
    rows = daily.evidence_packets(items, pages, evidence.PacketLimits()).orderBy("place").collect()
    assert [(r.kind, r.evidence_text, r.label, r.abstract_only) for r in rows] == [
        ("text", "Claims need proof.", None, False), ("figure", "Figure 1: proof", "Figure 1", False), ("text", "Short.", None, True)]
    packet = spark.createDataFrame([("p", r.evidence_id, r.kind, r.abstract_only, r.place) for r in rows] +
                                   [("q", r.evidence_id, r.kind, r.abstract_only, r.place) for r in rows],
                                   "paper_id string, evidence_id string, kind string, abstract_only boolean, pos long")

    def answer(paper, *ids):
        claim = {"claim_id": "c", "kind": "insight", "text": "t", "source_type": "paper_text", "inferred": False, "evidence_ids": list(ids)}
        return (paper, json.dumps({"paper_id": paper, "english_title": "T", "insights": [claim]}))

    given = spark.createDataFrame([answer("p", rows[0].evidence_id), answer("q", rows[2].evidence_id), ("r", "oops"),
                                   ("s", '{"paper_id": "s", "english_title": "T"}')], "paper_id string, answer string")
    reports, issues = daily.validated(given, packet)
    assert {r.paper_id: r.result_status for r in reports.collect()} == {"p": "validated", "q": "invalid", "r": "failed", "s": "partial"}
    assert {(r.paper_id, r.code) for r in issues.collect()} == {("q", "abstract_only_insight"), ("s", "core_insight_missing")}


def test_manifest(spark):
    stages = spark.createDataFrame([("candidates", "success", 9, 5, 0), ("documents", "partial", 5, 4, 1), ("delivery", "failed", 4, 0, 4)],
                                   "stage string, status string, input_count long, output_count long, partial_failure_count long")
    row = daily.manifest(stages, "r1").first()
    assert (row.run_id, row.run_status, row.input_count, row.output_count, row.partial_failure_count) == ("r1", "partial", 18, 9, 5)


def _documents(spark):
    items = spark.createDataFrame(
        [(f"arxiv:2401.0000{k}", 0, "1 Introduction", "section_header", 1, 1) for k in (1, 2)]
        + [(f"arxiv:2401.0000{k}", 1, "Proof.", "text", 1, 1) for k in (1, 2)],
        "doc_id string, pos long, text string, label string, level int, pdf_page long",
    ).selectExpr("*", "double(10) AS raw_left", "double(10 + 20 * pos) AS raw_top", "double(90) AS raw_right",
                 "double(20 + 20 * pos) AS raw_bottom", "'top_left' AS origin", "array(bigint(99)) AS caption_refs")
    pages = items.selectExpr("doc_id", "bigint(1) AS pdf_page", "double(100) AS width", "double(100) AS height").distinct()
    return items, pages


def _answer(packets):
    claim = ("named_struct('claim_id', 'c', 'kind', 'insight', 'text', 't', 'source_type', 'paper_text', 'inferred', false, "
             "'evidence_ids', array(if(doc_id LIKE '%1', evidence_id, 'nowhere')))")
    return packets.selectExpr("doc_id AS paper_id", f"to_json(named_struct('paper_id', doc_id, 'english_title', 'T', 'insights', array({claim}))) AS answer")


def test_run_reuses_what_has_not_changed(spark, tables, tmp_path):
    items, pages = _documents(spark)
    inputs = {"collections": tables["collections"], "items": tables["items"], "entries": _entries(tables), "document_items": items, "document_pages": pages}
    asked = {"embed": 0, "answer": 0}

    def embed(df):
        asked["embed"] += df.count()
        return _embed(tables)(df)

    def answer(packets):
        asked["answer"] += packets.select("doc_id").distinct().count()
        return _answer(packets)

    def go(name, day, **changed):
        kinds = {"embeddings": "array<double>", "answers": "string", "reports": "string"}
        stores = daily.Stores(**{k: ResultStore(spark, f"{tmp_path}/store/{k}", v, 4) for k, v in kinds.items()},
                              now=datetime(2024, 1, 3) + timedelta(days=day), embedding_identity="e1", answer_identity="a1", rules_identity="r1")
        asked.update(embed=0, answer=0)
        row = daily.run({**inputs, **changed}, embed, answer, SETTINGS, f"{tmp_path}/{name}", evidence.PacketLimits(), stores).first()
        assert row.failure is None
        read = lambda kind: {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/{kind}").select(*columns[kind]).collect()}
        return row.run_status, {kind: read(kind) for kind in columns}, dict(asked), stores

    columns = {"candidates": ["paper_id", "rank", "final_score"], "reports": ["paper_id", "result_status", "error_count"], "issues": ["paper_id", "code", "field_path"]}
    plain = daily.run(inputs, _embed(tables), _answer, SETTINGS, f"{tmp_path}/plain", evidence.PacketLimits()).first()
    status, first, counted, stores = go("first", 0)
    assert counted == {"embed": 4, "answer": 2} and status == plain.run_status
    for kind, rows in first.items():
        assert rows == {tuple(r) for r in spark.read.parquet(f"{tmp_path}/plain/{kind}").select(*columns[kind]).collect()}
    assert spark.read.parquet(f"{tmp_path}/first/packet_cuts").count() == 2
    again = go("again", 1)
    assert again[1] == first and again[2] == {"embed": 0, "answer": 0}
    # A changed document is answered anew, alone.
    edited = items.withColumn("text", F.when(F.col("doc_id").like("%2") & (F.col("pos") == 1), "New proof.").otherwise(F.col("text")))
    assert go("edited", 2, document_items=edited)[2] == {"embed": 0, "answer": 1}
    # After a week all of the first day is computed again.
    assert go("expired", 7)[2] == {"embed": 4, "answer": 2}
    before = stores.embeddings.usable(stores.now + timedelta(days=7)).collect()
    stores.embeddings.compact(stores.now + timedelta(days=7))
    assert len(stores.embeddings.generations()) == 1
    assert sorted(stores.embeddings.usable(stores.now + timedelta(days=7)).collect()) == sorted(before) and len(before) == 4


def test_run_writes_every_stage(spark, tables, tmp_path):
    items, pages = _documents(spark)
    answer = _answer
    inputs = {"collections": tables["collections"], "items": tables["items"], "entries": _entries(tables),
              "document_items": items, "document_pages": pages}
    row = daily.run(inputs, _embed(tables), answer, SETTINGS, str(tmp_path / "out"), evidence.PacketLimits()).first()
    assert row.run_status == "partial" and row.failure is None
    reports = {r.paper_id[-1]: r.result_status for r in spark.read.parquet(str(tmp_path / "out/reports")).collect()}
    assert reports == {"1": "validated", "2": "invalid"}
    decisions = {r.paper_id[-1]: r.decision for r in spark.read.parquet(str(tmp_path / "out/decisions")).collect()}
    assert decisions == {"1": "full", "2": "excluded"}

    def all_valid(packets):
        return answer(packets).withColumn("answer", F.replace("answer", F.lit("nowhere"), F.lit("x"))).join(
            packets.groupBy(F.col("doc_id").alias("paper_id")).agg(F.first("evidence_id").alias("e")), "paper_id"
        ).select("paper_id", F.replace("answer", F.lit('"x"'), F.concat(F.lit('"'), "e", F.lit('"'))).alias("answer"))

    row = daily.run(inputs, _embed(tables), all_valid, SETTINGS, str(tmp_path / "out"), evidence.PacketLimits()).first()
    # One chosen paper has no document, which makes the run partial and nothing more.
    assert (row.run_status, row.failure) == ("partial", None)
    # The rerun replaced the issues of the first run by none.
    assert spark.read.parquet(f"{tmp_path}/out/issues/run_id={SETTINGS.run_id}").count() == 0
    row = daily.run({**inputs, "entries": _entries(tables).limit(0)}, _embed(tables), answer, SETTINGS, str(tmp_path / "out"), evidence.PacketLimits()).first()
    assert (row.run_status, row.failure, row.output_count) == ("empty", None, 0)

    def broken(packets):
        raise RuntimeError("model is down")

    row = daily.run(inputs, _embed(tables), broken, SETTINGS, str(tmp_path / "failed"), evidence.PacketLimits()).first()
    assert (row.run_status, row.failure) == ("failed", "RuntimeError")
    assert spark.read.json(str(tmp_path / "failed/manifest")).first().run_status == "failed"
