"""Contracts of batches, manifests and answers, reader views and scorers over the given tables."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, functions as F

from lectern.operators import answers, contracts, feedback, quality, ranking, reader, scan, validation
from lectern.plans import bindings as b
from lectern.plans.bindings import rounded
from lectern.plans.ranking_plans import _VECTORS
from lectern.plans.run_plans import _STAGES_SQL, _stages
from lectern.session import materialize
from lectern.sources import feeds

LIMITS = contracts.BatchLimits(pool=12, shortlist=10, full=4)
STAGE_ORDER = ("candidates", "documents", "analysis", "validation", "delivery")
SCORERS = ("recency", "mean")


def batch_contract(spark, folder):
    """Customers are runs and their orders candidates named by date; places, ranks and selections are broken here and there."""
    orders = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("paper_id")
    )
    numbered = scan.ordered_scan(orders, ["run_id"], [F.col("k")], {"pos": scan.running_count()})
    # Stored, so that a task that compares places does not number the batch for every part again.
    placed = materialize(numbered.withColumn("pos", F.col("pos") + (F.col("run_id") % 50 == 7).cast("int")))
    k, pos, paper = F.col("k"), F.col("pos"), F.col("paper_id")
    rankings = placed.select(
        "run_id", "pos", F.when(k % 89 == 0, "lost").otherwise(paper).alias("paper_id"),
        (pos + (k % 97 == 0).cast("int")).alias("rank"), F.when(k % 113 == 0, 0.5).alias("llm_score"),
    )
    shortlist = placed.where(((pos <= LIMITS.shortlist) & (k % 71 != 0)) | ((pos == LIMITS.shortlist + 1) & (k % 5 == 0)))
    full = placed.where(pos <= LIMITS.full).withColumn("paper_id", F.when(k % 53 == 0, "lost").otherwise(paper))
    selections = shortlist.select("run_id", F.lit("shortlist").alias("kind"), "pos", "paper_id").unionByName(
        full.select("run_id", F.lit("full").alias("kind"), "pos", "paper_id")
    )
    issues = contracts.batch_issues(placed, rankings, selections, LIMITS)
    return issues.select(F.col("paper_id").alias("run_id"), "code")


def manifest_contract(spark, folder):
    """Customers are runs whose orders make up the stages; what their manifests claim differs in places."""
    run = F.col("run_id")
    rolled = quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"])
    place = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("stage"))
    stages = rolled.select(
        "run_id", "stage", F.when(run % 11 == 0, 6 - place).otherwise(place).alias("pos"),
        F.when((F.col("stage") == "candidates") & (run % 9 == 0), "empty").otherwise(F.col("stage_status")).alias("status"),
        (F.col("input_count") % 3).alias("cache_hit_count"), (F.col("output_count") % 2).alias("retry_count"), "partial_failure_count",
    )
    counters = ("cache_hit_count", "retry_count", "partial_failure_count")
    sums = stages.groupBy("run_id").agg(*[
        (F.sum(c) + F.max((run % m == 3).cast("int"))).alias(c) for c, m in zip(counters, (10, 14, 15))
    ])
    dates = b.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("published_count")
    )
    statuses = F.array(*[F.lit(s) for s in ("success", "partial", "failed", "partial")])
    manifests = sums.join(dates, "run_id").select(
        "run_id", *counters, "published_count", F.get(statuses, (run % 4).cast("int")).alias("status"),
        F.when(run % 13 == 0, F.col("last")).otherwise(F.col("first")).alias("started_at"),
        F.when(run % 13 == 0, F.col("first")).otherwise(F.col("last")).alias("completed_at"),
        (run % 5 == 0).alias("dry_run"), (run % 3 == 0).alias("send_requested"),
        (F.col("published_count") + (run % 17 == 0).cast("int")).alias("site_published_count"),
        F.col("published_count").alias("delivered_count"),
        (F.col("published_count") - (run % 23 == 0).cast("int")).alias("delivery_count"),
        F.md5(run.cast("string")).alias("artifact_hash"),
        F.md5((run + (run % 19 == 0).cast("int")).cast("string")).alias("site_artifact_hash"),
        F.when(run % 2 == 0, "sent").otherwise("skipped").alias("delivery_status"),
    )
    issues = contracts.manifest_issues(manifests, stages, STAGE_ORDER)
    return issues.select(F.col("paper_id").alias("run_id"), "code")


def _line_answers(spark, folder) -> DataFrame:
    """An answer per document whose lines in turn are insights, parameters, ablations, and visuals or modules."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("pos"), F.length(x).alias("n")))

    def taken(every, at):
        return F.filter(numbered, lambda e: e["pos"] % every == at)

    def when(bad, value, good):
        return F.when(bad, value).otherwise(good)

    def claim(e, kind):
        pos, n, digest = e["pos"], e["n"], F.md5(e["line"])
        return F.struct(
            when(pos % 9 == 8, F.lit(" "), F.concat(F.lit("c"), pos.cast("string"))).alias("claim_id"),
            when(pos % 5 == 4, F.lit("title"), F.lit(kind)).alias("kind"),
            when(pos % 7 == 6, F.lit("\t"), F.concat(F.lit("t"), e["line"])).alias("text"),
            when(n % 2 == 1, F.lit("system_inference"), F.lit("paper_text")).alias("source_type"),
            (n % 3 == 0).alias("inferred"),
            when(pos % 6 == 5, F.array(digest, digest), F.array(digest)).alias("evidence_ids"),
            (n / 200.0).alias("confidence"),
        )

    none = F.array().cast("array<string>")

    def parameter(e):
        pos = e["pos"]
        return F.struct(
            when(pos % 28 == 1, F.lit(""), F.lit("rate")).alias("name"), claim(e, "parameter").alias("role"),
            when(pos % 10 == 1, F.array(F.lit("e"), F.lit("e")), none).alias("evidence_ids"),
            when(pos % 12 == 1, F.array(F.lit("a"), F.lit("a")), none).alias("ablation_ids"),
            F.lit("paper_text").alias("source_type"), (pos % 16 == 1).alias("inferred"), F.when(pos % 20 != 1, 0.5).alias("confidence"),
        )

    def ablation(e):
        return F.struct(
            when(e["pos"] % 12 == 2, F.lit(" "), F.lit("without")).alias("ablation_id"),
            F.when(e["pos"] % 20 != 2, claim(e, "ablation")).alias("conclusion"),
            when(e["n"] % 4 == 0, none, F.array(F.lit("v"))).alias("visual_evidence_ids"),
        )

    def visual(e):
        return F.struct(
            when(e["n"] % 2 == 1, F.lit("other"), F.md5(e["line"])).alias("evidence_id"),
            when(e["n"] % 5 == 0, none, F.array(F.lit("i"))).alias("insight_ids"), claim(e, "support").alias("support_explanation"),
        )

    def module(e):
        return F.struct(when(e["pos"] % 16 == 7, F.lit(" "), F.lit("encoder")).alias("name"), claim(e, "method").alias("purpose"))

    payload = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("paper_id"), F.lit("lines").alias("english_title"),
        F.transform(taken(4, 0), lambda e: claim(e, "insight")).alias("insights"),
        F.transform(taken(4, 1), parameter).alias("parameters"), F.transform(taken(4, 2), ablation).alias("ablations"),
        F.transform(taken(8, 3), visual).alias("supporting_visuals"), F.transform(taken(8, 7), module).alias("method_modules"),
    ))
    return b.documents(spark, folder).where("doc_id IS NOT NULL").select("doc_id", payload.alias("answer"))


def answer_contract(spark, folder):
    issues = contracts.answer_issues(answers.parse(_line_answers(spark, folder), "answer"), "doc_id")
    field = F.split_part("field_path", F.lit("."), F.lit(1))
    return issues.groupBy(F.col("paper_id").alias("doc_id"), field.alias("field"), "code").agg(F.count("*").alias("n"))


_ANSWER_ISSUES_SQL = f"""WITH {b.LINES_SQL},
k AS (SELECT doc_id, pos, length(line) AS n, pos % 20 = 2 AS gone, CASE pos % 4 WHEN 0 THEN 'insights' WHEN 1 THEN 'parameters' WHEN 2 THEN 'ablations'
  ELSE CASE pos % 8 WHEN 3 THEN 'supporting_visuals' ELSE 'method_modules' END END AS field FROM lines),
codes AS (SELECT doc_id, field, unnest([CASE WHEN gone THEN 'claim_missing' END,
  CASE WHEN NOT gone AND pos % 9 = 8 THEN 'claim_id_blank' END, CASE WHEN NOT gone AND pos % 7 = 6 THEN 'claim_text_blank' END,
  CASE WHEN NOT gone AND pos % 5 = 4 THEN 'claim_kind_mismatch' END, CASE WHEN NOT gone AND pos % 6 = 5 THEN 'claim_evidence_repeated' END,
  CASE WHEN NOT gone AND (n % 2 = 1) <> (n % 3 = 0) THEN 'claim_origin_mismatch' END, CASE WHEN NOT gone AND n > 200 THEN 'confidence_out_of_range' END,
  CASE WHEN field = 'parameters' AND pos % 28 = 1 THEN 'parameter_name_blank' END,
  CASE WHEN field = 'parameters' AND (pos % 10 = 1 OR pos % 12 = 1) THEN 'parameter_references_repeated' END,
  CASE WHEN field = 'parameters' AND pos % 16 = 1 THEN 'parameter_origin_mismatch' END,
  CASE WHEN field = 'parameters' AND pos % 20 = 1 THEN 'parameter_confidence_out_of_range' END,
  CASE WHEN field = 'ablations' AND pos % 12 = 2 THEN 'ablation_id_blank' END, CASE WHEN field = 'ablations' AND n % 4 = 0 THEN 'ablation_without_visual' END,
  CASE WHEN field = 'supporting_visuals' AND n % 5 = 0 THEN 'visual_without_insight' END, CASE WHEN field = 'supporting_visuals' AND n % 2 = 1 THEN 'visual_not_cited' END,
  CASE WHEN field = 'method_modules' AND pos % 16 = 7 THEN 'module_name_blank' END]) AS code FROM k)
SELECT doc_id, field, code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY 1, 2, 3"""


_SWITCHES = tuple(itertools.product((False, True), repeat=3))
_QUERY = "  The "


def reader_views(spark, folder):
    """All settings of the three switches over all cards, searched in the paper id and the first line."""
    state = feedback.replay(b.commands(spark, folder))
    cards = b.documents(spark, folder).select(
        F.col("doc_id").alias("paper_id"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.split_part("text", F.lit("\n"), F.lit(1))).alias("searched")
    )
    modes = F.array(*[
        F.struct(
            F.lit(shown).alias("show_irrelevant"), F.lit(unread).alias("unread_only"), F.lit(marked).alias("favorites_only"),
            reader.visible(F.col("searched"), _QUERY, shown, unread, marked).alias("visible"),
        )
        for shown, unread, marked in _SWITCHES
    ])
    views = reader.with_state(cards, state).select("paper_id", F.explode(modes).alias("m")).select("paper_id", "m.*")
    return views.groupBy("show_irrelevant", "unread_only", "favorites_only").agg(
        F.count_if("visible").alias("n"), F.sum(F.when(F.col("visible"), F.col("paper_id"))).alias("ids")
    )


def scorers(spark, folder):
    scored = [
        ranking.scorer(name)(b.candidates(spark, folder), b.interests(spark, folder), "paper_id", "paper_id", "embedding")
        .select(F.lit(name).alias("scorer"), "paper_id", rounded("corpus_score").alias("score"))
        for name in SCORERS
    ]
    return functools.reduce(DataFrame.unionByName, scored)


def validation_results(spark, folder):
    """Customers are papers and nations batches; suppliers bring the run ids of a batch's inputs."""
    customers = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").alias("batch_id"), "c_acctbal")
    orders = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("paper_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("document_status")
    )
    first = orders.groupBy("paper_id").agg(F.min_by("document_status", "o_orderkey").alias("document_status"))
    codes = validation.input_codes(customers, customers.where("c_acctbal >= 0"), first, first, first)
    foreign = F.when(F.col("s_suppkey") % 40 == 0, "other").when(F.col("s_suppkey") % 41 != 0, "own")
    runs = b.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("batch_id"), foreign.alias("run_id"))
    return validation.batch_results(customers, codes, runs, customers.where("c_acctbal < 9000"))


def _library_entries(spark, folder) -> DataFrame:
    """Documents as the library service would list them; some lack a key or a readable date, some are of other kinds."""
    doc = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in (*feeds.PAPER_ITEM_TYPES, "book")])
    added = F.when(doc % 11 == 0, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((doc % 28 + 1).cast("string"), 2, "0"), F.lit("T08:00:00Z")))
    data = F.struct(
        F.get(kinds, (doc % 4).cast("int")).alias("itemType"), F.col("source").alias("title"), F.col("text").alias("abstractNote"),
        F.when(doc % 5 != 0, F.array("lang")).alias("collections"), added.alias("dateAdded"),
    )
    entry = F.to_json(F.struct(F.when(doc % 13 != 0, doc.cast("string")).alias("key"), data.alias("data")))
    return b.documents(spark, folder).where("doc_id IS NOT NULL").select(F.when(doc % 17 == 0, F.left(entry, F.lit(20))).otherwise(entry).alias("entry"))


def library_items(spark, folder):
    items, _ = feeds.library_items(_library_entries(spark, folder), "entry")
    return items.select(
        "key", "title", F.length("abstract").cast("bigint").alias("n_chars"), F.size("collection_keys").cast("bigint").alias("n_collections"),
        F.date_format("added_at", "yyyy-MM-dd").alias("day"),
    )


def library_counts(spark, folder):
    return feeds.library_items(_library_entries(spark, folder), "entry")[1]


def preprint_rejects(spark, folder):
    """Documents as preprints of one server: papers by category, and why the other wanted rows make none."""
    doc = F.col("doc_id")
    rows = b.documents(spark, folder).where("doc_id IS NOT NULL").select(
        F.when(doc % 7 != 0, F.col("source")).alias("title"), F.when(doc % 5 != 0, "A; B").alias("authors"), F.when(doc % 6 != 0, F.col("text")).alias("abstract"),
        F.when(doc % 10 != 9, F.concat(F.lit("10.1/"), doc.cast("string"))).alias("doi"), F.when(doc % 12 != 11, "1").alias("version"),
        F.when(doc % 3 == 0, "2024-05-01").otherwise("2024-05-02").alias("date"), F.col("lang").alias("category"),
    )
    papers, rejected = feeds.preprint_papers(rows, "server", ["EN", "de"])
    told = papers.select(F.lit("paper").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return told.groupBy("outcome").agg(F.count("*").alias("n"))


_LIBRARY_SQL = """WITH e AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'malformed' WHEN doc_id % 4 = 3 THEN 'other_kinds'
  WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 'malformed' ELSE 'items' END AS state FROM documents)"""

PLANS = {
    "library_items": (
        library_items,
        f"""{_LIBRARY_SQL} SELECT CAST(doc_id AS VARCHAR) AS key, source AS title, length(text) AS n_chars,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_collections, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM e WHERE state = 'items'""",
    ),
    "library_counts": (
        library_counts,
        f"""{_LIBRARY_SQL} SELECT count(*) FILTER (WHERE state = 'items') AS items, count(*) FILTER (WHERE state = 'other_kinds') AS other_kinds,
  count(*) FILTER (WHERE state = 'malformed') AS malformed FROM e""",
    ),
    "preprint_rejects": (
        preprint_rejects,
        """SELECT CASE WHEN doc_id % 7 = 0 THEN 'title_missing' WHEN doc_id % 5 = 0 THEN 'authors_missing' WHEN doc_id % 6 = 0 THEN 'abstract_missing'
  WHEN doc_id % 10 = 9 THEN 'doi_missing' WHEN doc_id % 12 = 11 THEN 'version_missing' ELSE 'paper' END AS outcome, count(*) AS n
FROM documents WHERE doc_id % 3 <> 0 AND lang IN ('en', 'de') GROUP BY 1""",
    ),
    "batch_contract": (
        batch_contract,
        """WITH c AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 50 = 7 THEN 1 ELSE 0 END AS pos,
  strftime(o_orderdate, '%Y-%m-%d') AS paper_id, o_orderkey AS k FROM orders),
r AS (SELECT run_id, unnest([CASE WHEN count(*) > 12 THEN 'candidates_over_pool' END, CASE WHEN count(DISTINCT paper_id) < count(*) THEN 'candidate_id_not_unique' END,
  CASE WHEN run_id % 50 = 7 THEN 'candidate_place_missing' END, CASE WHEN bool_or(k % 89 = 0) THEN 'ranking_not_in_candidate_order' END,
  CASE WHEN bool_or(k % 97 = 0) THEN 'rank_not_consecutive' END,
  CASE WHEN bool_or((pos <= 10 AND k % 71 = 0) OR (pos = 11 AND k % 5 = 0)) THEN 'shortlist_not_prefix' END,
  CASE WHEN bool_or(pos <= 4 AND k % 53 = 0) THEN 'full_analysis_not_prefix' END, CASE WHEN bool_or(k % 113 = 0) THEN 'llm_score_before_its_stage' END]) AS code FROM c GROUP BY 1)
SELECT run_id, code FROM r WHERE code IS NOT NULL""",
    ),
    "manifest_contract": (
        manifest_contract,
        f"""WITH {_STAGES_SQL},
d AS (SELECT run_id, CASE WHEN bool_or(stage = 'candidates') AND run_id % 9 = 0 THEN 'empty'
  WHEN bool_or(stage_status = 'failed' AND stage <> 'delivery' AND NOT (stage = 'candidates' AND run_id % 9 = 0)) THEN 'failed'
  WHEN bool_or(stage_status = 'partial' OR partial_failure_count > 0 OR stage_status = 'failed') THEN 'partial' ELSE 'success' END AS derived, count(*) AS n FROM rolled GROUP BY run_id),
m AS (SELECT o_custkey AS run_id, min(o_orderdate) < max(o_orderdate) AS spread FROM orders GROUP BY 1),
r AS (SELECT run_id, unnest([CASE WHEN run_id % 13 = 0 AND spread THEN 'completed_before_started' END, CASE WHEN run_id % 15 = 0 THEN 'dry_run_requests_sending' END,
  CASE WHEN n < 5 OR run_id % 11 = 0 THEN 'stages_out_of_order' END, CASE WHEN run_id % 10 = 3 THEN 'cache_hit_count_total_mismatch' END,
  CASE WHEN run_id % 14 = 3 THEN 'retry_count_total_mismatch' END, CASE WHEN run_id % 15 = 3 THEN 'partial_failure_count_total_mismatch' END,
  CASE WHEN run_id % 17 = 0 THEN 'published_count_mismatch' END, CASE WHEN run_id % 23 = 0 THEN 'delivered_count_mismatch' END,
  CASE WHEN run_id % 19 = 0 THEN 'artifact_hash_mismatch' END, CASE WHEN run_id % 2 = 0 AND (run_id % 5 = 0 OR run_id % 3 <> 0) THEN 'sent_without_request' END,
  CASE WHEN derived <> ['success', 'partial', 'failed', 'partial'][run_id % 4 + 1] THEN 'run_status_not_derived' END]) AS code FROM d JOIN m USING (run_id))
SELECT run_id, code FROM r WHERE code IS NOT NULL""",
    ),
    "answer_contract": (answer_contract, _ANSWER_ISSUES_SQL),
    "reader_views": (
        reader_views,
        f"""WITH {b.STATE_SQL},
v AS (SELECT doc_id, coalesce(irrelevant, false) AS irrelevant, coalesce(read, false) AS read, coalesce(favorite, false) AS favorite,
  contains(lower(doc_id || ' ' || split_part(text, chr(10), 1)), 'the') AS found FROM documents LEFT JOIN state ON paper_id = doc_id),
f AS (SELECT unnest([false, true]) AS x), m AS (SELECT a.x AS show_irrelevant, u.x AS unread_only, f.x AS favorites_only FROM f AS a, f AS u, f),
w AS (SELECT m.*, doc_id, found AND (show_irrelevant OR NOT irrelevant) AND (NOT unread_only OR NOT read) AND (NOT favorites_only OR favorite) AS visible FROM v, m)
SELECT show_irrelevant, unread_only, favorites_only, count(*) FILTER (WHERE visible) AS n, CAST(sum(doc_id) FILTER (WHERE visible) AS BIGINT) AS ids FROM w GROUP BY 1, 2, 3""",
    ),
    "scorers": (
        scorers,
        f"""WITH {_VECTORS} SELECT 'recency' AS scorer, paper_id, round(corpus_score, 6) + 0.0 AS score FROM corpus
UNION ALL SELECT 'mean', paper_id, round(mean_cosine * 10, 6) + 0.0 FROM corpus""",
    ),
    "validation_results": (
        validation_results,
        """WITH o AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1),
mixed AS (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING bool_or(s_suppkey % 40 = 0) AND bool_or(s_suppkey % 40 <> 0 AND s_suppkey % 41 <> 0) OR bool_or(s_suppkey % 40 <> 0 AND s_suppkey % 41 = 0)),
x AS (SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM mixed) THEN 'validation_run_id_mismatch' WHEN c_acctbal < 0 THEN 'validation_candidate_missing'
  WHEN st IS NULL THEN 'validation_input_missing' WHEN st = 'F' THEN 'validation_document_unavailable' WHEN c_acctbal >= 9000 THEN 'validation_internal_error' END AS code
  FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey AS paper_id, code, CASE WHEN code = 'validation_input_missing' THEN 'skipped' WHEN code IS NOT NULL THEN 'failed' END AS status FROM x""",
    ),
}
