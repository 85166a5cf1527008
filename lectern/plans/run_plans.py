"""Feedback, metrics, caching and run-status queries."""

from __future__ import annotations

import functools
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lectern.functions.fixedpoint import int_div
from lectern import sinks
from lectern.operators import caching, constraints, feedback, quality, scan, usage
from lectern.operators.result_store import ResultStore, reuse
from lectern.plans import bindings as b
from lectern.session import materialize, shared_folder
from lectern.streaming import bundle_import as bundles, feedback_stream as feedback_import


def feedback_state(spark, folder):
    return feedback.replay(b.commands(spark, folder))


def feedback_stream(spark, folder):
    """The same log as a file stream, imported micro-batch by micro-batch into snapshots."""
    events = (
        spark.readStream.schema(b.table(spark, folder, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    run = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    feedback_import.start(b.as_commands(events), f"{run}/state", f"{run}/log").awaitTermination()
    state = feedback_import.current_state(spark, f"{run}/state", feedback_import.newest_version(spark, f"{run}/state"))
    return state.select(
        "paper_id", "read", "favorite", "irrelevant",
        F.col("read_watermark.occurred_at").alias("read_watermark"),
        F.col("preference_watermark.occurred_at").alias("preference_watermark"),
    )


def bundle_import(spark, folder):
    """Each device's commands of a week as a bundle; after the import all bundles of the first week come again."""
    names = [c.split()[0] for c in bundles.COMMAND.split(", ")]
    command = F.struct(*[F.col(n).cast("string").alias(n) if n.endswith("_id") else F.col(n) for n in names])
    week = F.date_trunc("week", "occurred_at")
    grouped = b.commands(spark, folder).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).groupBy("device_id", week.alias("week")).agg(
        F.max("occurred_at").alias("generated_at"), F.collect_list(command).alias("commands")
    )
    identity = F.concat_ws("-", F.col("device_id"), F.date_format("week", "yyyyMMdd"))
    run = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    made = materialize(grouped.select("week", identity.alias("bundle_id"), "generated_at", "commands"))
    first_week = made.agg(F.min("week")).scalar()
    for some in (made, made.where(F.col("week") == first_week)):
        some.drop("week").write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(made.drop("week").schema).parquet(f"{run}/in")
        bundles.start(stream, f"{run}/out", f"{run}/log").awaitTermination()
    return bundles.counters(spark.read.parquet(f"{run}/out"))


def feedback_projection(spark, folder):
    return feedback.projection(feedback.replay(b.commands(spark, folder)))


def _repeated_commands(spark, folder):
    """The log with every third command imported twice."""
    log = b.commands(spark, folder)
    return log.unionByName(log.where("sequence % 3 = 0"))


def feedback_effects(spark, folder):
    effects = feedback.command_effects(_repeated_commands(spark, folder))
    return effects.select("command_id", "paper_id", "duplicates", "changed", "conflict")


def feedback_counters(spark, folder):
    effects = feedback.command_effects(_repeated_commands(spark, folder))
    return feedback.merge_counters(effects, ["action"])


def bundle_order(spark, folder):
    """Commands of each device in the order of their papers, which is not the log order."""
    log = b.commands(spark, folder)
    bundle = log.withColumn("position", F.col("paper_id") * 1000000 + F.col("sequence") % 1000000)
    return feedback.out_of_order(bundle, "device_id", "position").select("command_id", "device_id")


_EFFECTS_SQL = (
    b.COMMANDS_SQL
    + """,
c AS (SELECT *, CAST(sequence % 3 = 0 AS BIGINT) AS duplicates, row_number() OVER (PARTITION BY paper_id ORDER BY occurred_at, device_id, sequence, command_id) AS pos FROM commands),
w AS (SELECT *,
  coalesce(last_value(CASE WHEN action = 'set_read' THEN value END IGNORE NULLS) OVER p, false) AS r0,
  coalesce(last_value(CASE WHEN action = 'set_favorite' OR (action = 'set_irrelevant' AND value) THEN action = 'set_favorite' AND value END IGNORE NULLS) OVER p, false) AS f0,
  coalesce(last_value(CASE WHEN action = 'set_irrelevant' OR (action = 'set_favorite' AND value) THEN action = 'set_irrelevant' AND value END IGNORE NULLS) OVER p, false) AS i0
  FROM c WINDOW p AS (PARTITION BY paper_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
effects AS (SELECT command_id, paper_id, action, duplicates, CASE action WHEN 'set_read' THEN r0 <> value
   WHEN 'set_favorite' THEN f0 <> value OR (value AND i0) ELSE i0 <> value OR (value AND f0) END AS changed,
   CASE action WHEN 'set_favorite' THEN value AND i0 WHEN 'set_irrelevant' THEN value AND f0 ELSE false END AS conflict FROM w)"""
)


def percentiles(spark, folder):
    lines = b.table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return scan.nearest_rank_percentiles(lines, ["l_returnflag"], "l_extendedprice", [25, 50, 75, 95])


def batch_rewrite(spark, folder):
    """A run written twice holds the second batch only, and a run of no rows reads as no rows."""
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    sinks.write_batch(orders, path, "first")
    sinks.write_batch(orders.where("o_orderstatus <> 'F'"), path, "first")
    sinks.write_batch(orders, path, "second")
    sinks.write_batch(orders.where("o_orderkey < 0"), path, "second")
    kept = sinks.read_batch(spark, path, "first").unionByName(sinks.read_batch(spark, path, "second"))
    return kept.groupBy("run_id", "o_orderstatus").agg(F.count("*").alias("n"))


def paired_comparison(spark, folder):
    """Each line is a pair: its price, and its price after the discount."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    kept = 100 - F.round(F.col("l_discount") * 100).cast("bigint")
    lines = b.table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.explode(F.create_map(F.lit("baseline"), price, F.lit("improved"), int_div(price * kept, F.lit(100)))).alias("variant", "ns"),
    )
    return quality.paired_comparison(lines, ["l_returnflag"])


def _profile(spark, folder):
    docs = b.table(spark, folder, "documents").select("source", "lang", "n_chars", F.octet_length("text").alias("bytes"))
    profile = docs.groupBy(F.col("lang").alias("symbol")).agg(
        F.sum("n_chars").alias("cumulative_time"), F.sum("bytes").alias("allocation_bytes"),
    ).withColumn("eligible", F.col("symbol") != "es")
    totals = docs.agg(F.sum("n_chars").alias("t"), F.sum("bytes").alias("n"))
    return quality.hot_spots(profile, totals.select("t").scalar(), totals.select("n").scalar())


def hot_spots(spark, folder):
    return _profile(spark, folder).select("symbol", "time_share_ppm", "allocation_share_ppm", "largest_share_ppm")


def optimization_target(spark, folder):
    return quality.optimization_target(_profile(spark, folder)).select(
        "symbol", "cumulative_time", "time_share_ppm", "allocation_share_ppm"
    )


def ranking_quality(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    good = b.table(spark, folder, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("relevant"))
    ranked = scan.ordered_scan(
        docs, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], {"rank": scan.running_count()}
    )
    labelled = ranked.join(good, "doc_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return quality.ranking_quality(labelled, ["lang"])


def label_quality(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(b.table(spark, folder, "labels"), "doc_id", "left")
    rows = joined.withColumn("domain", F.explode(F.array(*[F.lit(d) for d in ("evidence", "claim", "field")]))).select(
        "lang", "domain",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("expected"),
        F.when(F.col("domain") == "evidence", F.col("n_chars") > 300)
        .otherwise(F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("accepted"),
        F.coalesce((F.col("toxic") == 0) & (F.col("quality") == 1), F.lit(False)).alias("supported"),
        F.col("quality").isNotNull().alias("present"),
    )
    return quality.label_quality(rows, ["lang"])


def _stage_name(priority):
    names = ["candidates", "documents", "analysis", "validation", "delivery"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.substring(priority, 1, 1).cast("int"))


def _stages(spark, folder):
    """Orders as paper results: a stage per customer and priority."""
    orders = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"), _stage_name("o_orderpriority").alias("stage"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "P", "partial")
        .otherwise("failed").alias("status"),
    )
    return orders


_STAGES_SQL = """
papers AS (SELECT o_custkey AS run_id, ['candidates', 'documents', 'analysis', 'validation', 'delivery'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS stage,
  o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status FROM orders),
stages AS (SELECT run_id, stage, count(*) AS input_count, count(*) FILTER (WHERE status <> 'failed') AS output_count,
  count(*) FILTER (WHERE status <> 'success') AS partial_failure_count FROM papers GROUP BY 1, 2),
rolled AS (SELECT *, CASE WHEN output_count = 0 THEN 'failed' WHEN partial_failure_count > 0 THEN 'partial' ELSE 'success' END AS stage_status FROM stages)"""


def stage_rollup(spark, folder):
    return quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"])


def run_status(spark, folder):
    rolled = quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"]).withColumn(
        "status", F.when((F.col("stage") == "candidates") & (F.col("run_id") % 9 == 0), "empty").otherwise(F.col("stage_status"))
    )
    return quality.run_status(rolled, "run_id")


def error_codes(spark, folder):
    papers = _stages(spark, folder).withColumn(
        "code", F.when(F.col("status") != "success", F.concat_ws("_", "stage", "status"))
    )
    return quality.first_seen_codes(papers, ["run_id"], "code", "o_orderkey").select(
        "run_id", F.array_join("error_codes", ",").alias("error_codes")
    )


def stage_contract(spark, folder):
    rolled = quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"])
    status = F.when(F.col("run_id") % 7 == 0, "success").when(F.col("run_id") % 7 == 1, "failed").otherwise(F.col("stage_status"))
    codes = F.when(F.col("partial_failure_count") > 0, F.array(F.lit("paper_failed"))).otherwise(F.array().cast("array<string>"))
    stages = rolled.select(
        F.col("run_id"), "stage", status.alias("status"), "input_count", "output_count",
        F.lit(0).alias("cache_hit_count"), F.lit(0).alias("retry_count"), "partial_failure_count", codes.alias("error_codes"),
    )
    issues = constraints.stage_issues(stages)
    return issues.groupBy(F.col("paper_id").alias("run_id"), "code").agg(F.count("*").alias("n"))


def funnel_contract(spark, folder):
    by_stage = _stages(spark, folder).groupBy("run_id").agg(
        *[F.count_if(F.col("stage") == s).alias(n) for s, n in (
            ("candidates", "candidate_count"), ("documents", "selected_count"), ("analysis", "analyzed_count"),
            ("validation", "validated_count"), ("delivery", "published_count"))]
    ).withColumn("delivered_count", F.col("published_count"))
    issues = constraints.funnel_issues(by_stage, "run_id")
    return issues.select(F.col("paper_id").alias("run_id"), "code")


def run_totals(spark, folder):
    stages = quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"])
    claimed = _stages(spark, folder).groupBy("run_id").agg(
        F.count("*").alias("input_count"),
        (F.count_if(F.col("status") != "success") + F.when(F.col("run_id") % 10 == 3, 1).otherwise(0)).alias("partial_failure_count"),
    )
    issues = constraints.total_issues(claimed, stages, "run_id", ["input_count", "partial_failure_count"])
    return issues.select(F.col("paper_id").alias("run_id"), "code")


def metric_reconcile(spark, folder):
    """Measured durations joined to stage results; a stage without its counterpart is an error."""
    measured = _stages(spark, folder).where("status <> 'partial'").groupBy("run_id", "stage").agg(
        F.sum("o_orderkey").alias("duration_ns")
    )
    results = quality.stage_rollup(_stages(spark, folder), ["run_id", "stage"])
    joined = quality.reconciled_metrics(measured, results, ["run_id", "stage"])
    return joined.groupBy("stage").agg(
        F.count_if(F.col("mismatch") == "unmeasured").alias("unmeasured"),
        F.sum("duration_ns").alias("duration_ns"), F.sum("output_count").alias("output_count"),
    )


def budget_verdicts(spark, folder):
    runs = b.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count("*").alias("candidate_count"),
        F.count_if(F.col("o_orderstatus") == "O").alias("selected_for_llm_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("selected_for_analysis_count"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("successful_analysis_call_count"),
        F.count_if(F.col("o_orderpriority") <= "3").alias("analysis_attempt_count"),
        F.sum(F.lit(2048)).alias("configured_output_token_count"),
        F.count_if(F.col("o_totalprice") > 499000).alias("offline_network_call_count"),
        F.lit(0).alias("offline_paid_call_count"),
        F.sum(F.floor("o_totalprice") * 64).alias("peak_traced_allocation_bytes"),
        F.max(F.when(F.col("o_custkey") % 2 == 0, 4_500_000).otherwise(None)).cast("bigint").alias("maximum_batch_cost_micro_usd"),
        F.sum(F.when(F.col("o_custkey") % 2 == 0, F.floor("o_totalprice"))).alias("estimated_cost_micro_usd"),
    )
    return quality.budget_verdict(runs).select("run_id", "candidate_count", "estimated_cost_micro_usd", "passed")


def _cache_results(spark, folder):
    docs = b.table(spark, folder, "documents").select("doc_id", caching.cache_key(F.col("text"), "model-a").alias("key"), "text")
    stored = (
        b.table(spark, folder, "labels").join(docs, "doc_id")
        .groupBy("key").agg(F.max(F.octet_length("text").cast("bigint")).alias("value"), F.min("doc_id").alias("_d"))
        .withColumn("payload_hash", F.when(F.col("_d") % 10 == 0, "corrupt").otherwise(F.sha2(F.to_json(F.struct("value")), 256)))
        .drop("_d")
    )
    return caching.with_cache(
        docs, stored, "key", lambda missing: missing.withColumn("value", F.octet_length("text").cast("bigint")), "value"
    )


def cache_miss_join(spark, folder):
    results, _ = _cache_results(spark, folder)
    return results.select("doc_id", "value", "cache_hit")


def cache_new_entries(spark, folder):
    _, entries = _cache_results(spark, folder)
    return entries.select("key", "value")


_RUNS = ((datetime(2024, 1, 1), "lang IN ('de', 'fr')"), (datetime(2024, 1, 4), "lang <> 'es'"), (datetime(2024, 1, 9), "true"))


def incremental_run(spark, folder):
    """Three runs against one store, each over more languages; the first run's results expire before the third."""
    store = ResultStore(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", "bigint")
    docs = b.table(spark, folder, "documents").select(
        "doc_id", "lang", caching.cache_key(F.col("text"), "model-a").alias("key"), "text"
    )
    runs = []
    for number, (now, arrived) in enumerate(_RUNS, 1):
        compute = lambda missing: missing.select("key", F.octet_length("text").cast("bigint").alias("n_bytes"))
        found = reuse(docs.where(arrived), "key", store, compute, "n_bytes", now, ttl_days=7)
        runs.append(materialize(found.select(F.lit(number).alias("run"), "doc_id", "n_bytes", "cache_hit")))
        store.compact(now)
    return functools.reduce(DataFrame.unionByName, runs)


def usage_observation(spark, folder):
    """A model stage over all conversations: user turns are prompts, the next turn is the answer, others fail."""
    turns = b.table(spark, folder, "conversations")
    after = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left")
    tries = F.col("turn") % 3 + 1
    metrics = usage.model_metrics(F.col("text"), F.col("answer"), tries, tries * 125)
    folder_of_run = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    seen = usage.observed_write(asked, metrics, lambda rows: rows.write.mode("overwrite").parquet(folder_of_run))
    return spark.createDataFrame([tuple(seen[m] for m in metrics)], ", ".join(f"{m} bigint" for m in metrics))


def ledger_anti_join(spark, folder):
    events = b.table(spark, folder, "events")
    ledger = events.where("event_type = 'error' AND event_id % 5 = 0").select(
        F.get_json_object("props", "$.k").alias("delivery_key"))
    requests = events.where("event_type = 'purchase'").select(
        F.concat(F.get_json_object("props", "$.k"), F.when(F.col("user_id") % 3 == 0, "-x").otherwise("")).alias("delivery_key"),
        "event_id", "ts", "user_id",
    )
    return caching.undelivered(requests, ledger, "delivery_key", ["ts", "event_id"])


def cache_freshness(spark, folder):
    events = b.table(spark, folder, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 3 DAY")).alias("now")).scalar()
    state = caching.freshness(F.col("ts"), F.col("_now"), 7)
    return events.withColumn("_now", now).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def stale_files(spark, folder):
    listing = b.table(spark, folder, "pages").select(F.concat(F.lit("papers/"), "page_id", F.lit(".html")).alias("path"))
    keep = b.table(spark, folder, "labels").where("quality = 1").select(F.concat(F.lit("papers/"), "doc_id", F.lit(".html")).alias("path"))
    return caching.stale_files(listing, keep, "path")


def artifact_totals(spark, folder):
    files = b.table(spark, folder, "documents").select("source", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return caching.artifact_totals(files, ["source"], 50, 100_000)


PLANS = {
    "feedback_state": (feedback_state, f"WITH {b.STATE_SQL} SELECT * FROM state"),
    "feedback_stream": (feedback_stream, f"WITH {b.STATE_SQL} SELECT * FROM state"),
    "feedback_projection": (
        feedback_projection,
        f"""WITH {b.STATE_SQL} SELECT paper_id, 'read' AS flag FROM state WHERE read UNION ALL SELECT paper_id, 'favorite' FROM state WHERE favorite
UNION ALL SELECT paper_id, 'irrelevant' FROM state WHERE irrelevant""",
    ),
    "feedback_effects": (
        feedback_effects,
        f"WITH {_EFFECTS_SQL} SELECT command_id, paper_id, duplicates, changed, conflict FROM effects",
    ),
    "feedback_counters": (
        feedback_counters,
        f"""WITH {_EFFECTS_SQL} SELECT action, count(*) AS applied_count, count(*) FILTER (WHERE changed) AS changed_count,
  CAST(sum(duplicates) AS BIGINT) AS duplicate_count, count(*) FILTER (WHERE conflict) AS conflict_count FROM effects GROUP BY 1""",
    ),
    "bundle_order": (
        bundle_order,
        f"""WITH {b.COMMANDS_SQL}, o AS (SELECT *, (occurred_at, device_id, sequence, command_id) AS place FROM commands),
m AS (SELECT command_id, device_id, place, max(place) OVER (PARTITION BY device_id ORDER BY paper_id * 1000000 + sequence % 1000000
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM o)
SELECT command_id, device_id FROM m WHERE prior > place""",
    ),
    "percentiles": (
        percentiles,
        """SELECT l_returnflag, count(*) AS n, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS p25,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS p50, percentile_disc(0.75) WITHIN GROUP (ORDER BY l_extendedprice) AS p75,
  percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice) AS p95 FROM lineitem GROUP BY 1""",
    ),
    "batch_rewrite": (
        batch_rewrite,
        "SELECT 'first' AS run_id, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2",
    ),
    "paired_comparison": (
        paired_comparison,
        """WITH l AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, 100 - CAST(round(l_discount * 100) AS BIGINT) AS kept FROM lineitem),
s AS (SELECT l_returnflag, true AS base, price AS ns FROM l UNION ALL SELECT l_returnflag, false, price * kept // 100 FROM l),
p AS (SELECT l_returnflag, count(*) FILTER (WHERE base) AS pair_count,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY ns) FILTER (WHERE base) AS b50, percentile_disc(0.5) WITHIN GROUP (ORDER BY ns) FILTER (WHERE NOT base) AS i50,
  percentile_disc(0.95) WITHIN GROUP (ORDER BY ns) FILTER (WHERE base) AS b95, percentile_disc(0.95) WITHIN GROUP (ORDER BY ns) FILTER (WHERE NOT base) AS i95 FROM s GROUP BY 1),
r AS (SELECT *, CASE WHEN b50 >= i50 THEN ((b50 - i50) * 1000000 + b50 // 2) // b50 ELSE -(((i50 - b50) * 1000000 + b50 // 2) // b50) END AS imp,
  (i95 * 1000000 + b95 // 2) // b95 AS ratio FROM p)
SELECT l_returnflag, pair_count, b50 AS baseline_median_ns, i50 AS improved_median_ns, b95 AS baseline_p95_ns, i95 AS improved_p95_ns,
  imp AS improvement_ppm, ratio AS p95_ratio_ppm, imp >= 100000 AND ratio <= 1050000 AS passed FROM r""",
    ),
    "hot_spots": (
        hot_spots,
        """WITH p AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS t, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n FROM documents GROUP BY 1),
s AS (SELECT lang, (t * 1000000 + (SELECT sum(t)::BIGINT FROM p) // 2) // (SELECT sum(t)::BIGINT FROM p) AS a, (n * 1000000 + (SELECT sum(n)::BIGINT FROM p) // 2) // (SELECT sum(n)::BIGINT FROM p) AS b FROM p)
SELECT lang AS symbol, a AS time_share_ppm, b AS allocation_share_ppm, greatest(a, b) AS largest_share_ppm FROM s WHERE lang <> 'es'""",
    ),
    "optimization_target": (
        optimization_target,
        """WITH p AS (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS t, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n FROM documents GROUP BY 1),
s AS (SELECT lang, t, (t * 1000000 + (SELECT sum(t)::BIGINT FROM p) // 2) // (SELECT sum(t)::BIGINT FROM p) AS a, (n * 1000000 + (SELECT sum(n)::BIGINT FROM p) // 2) // (SELECT sum(n)::BIGINT FROM p) AS b FROM p)
SELECT lang AS symbol, t AS cumulative_time, a AS time_share_ppm, b AS allocation_share_ppm FROM s WHERE lang <> 'es' AND greatest(a, b) >= 200000
ORDER BY greatest(a, b) DESC, t DESC, lang LIMIT 1""",
    ),
    "ranking_quality": (
        ranking_quality,
        """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, d.doc_id) AS rank, coalesce(quality = 1, false) AS rel
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
a AS (SELECT lang, count(*) AS evaluated_count, count(*) FILTER (WHERE rel) AS relevant_count, count(*) FILTER (WHERE rel AND rank <= 5) AS t5,
  count(*) FILTER (WHERE rel AND rank <= 15) AS t15, CAST(coalesce(sum([1000000, 630930, 500000, 430677, 386853][rank]) FILTER (WHERE rel AND rank <= 5), 0) AS BIGINT) AS dcg FROM r GROUP BY 1),
b AS (SELECT *, CAST(list_sum([1000000, 630930, 500000, 430677, 386853][1:least(relevant_count, 5)]) AS BIGINT) AS ideal FROM a)
SELECT lang, evaluated_count, relevant_count, (t5 * 1000000 + 2) // 5 AS precision_at_5_ppm, (t15 * 1000000 + relevant_count // 2) // relevant_count AS recall_at_15_ppm,
  (dcg * 1000000 + ideal // 2) // ideal AS ndcg_at_5_ppm FROM b""",
    ),
    "label_quality": (
        label_quality,
        """WITH j AS (SELECT lang, coalesce(quality = 1, false) AS e, n_chars > 300 AS a, coalesce(toxic = 0, false) AS ca, coalesce(toxic = 0 AND quality = 1, false) AS s, quality IS NOT NULL AS p
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT lang, count(*) FILTER (WHERE e) AS expected_evidence_count, count(*) FILTER (WHERE a) AS accepted_evidence_count, count(*) FILTER (WHERE e AND a) AS supported_evidence_count,
  count(*) FILTER (WHERE e AND NOT a) AS rejected_evidence_count, count(*) FILTER (WHERE ca) AS accepted_claim_count, count(*) FILTER (WHERE s) AS supported_claim_count,
  count(*) AS required_field_count, count(*) FILTER (WHERE p) AS present_field_count FROM j GROUP BY 1)
SELECT *, (supported_evidence_count * 1000000 + accepted_evidence_count // 2) // accepted_evidence_count AS evidence_precision_ppm,
  (supported_evidence_count * 1000000 + expected_evidence_count // 2) // expected_evidence_count AS evidence_recall_ppm,
  ((accepted_claim_count - supported_claim_count) * 1000000 + accepted_claim_count // 2) // accepted_claim_count AS unsupported_claim_rate_ppm,
  ((required_field_count - present_field_count) * 1000000 + required_field_count // 2) // required_field_count AS missing_required_field_rate_ppm FROM c""",
    ),
    "stage_rollup": (stage_rollup, f"WITH {_STAGES_SQL} SELECT * FROM rolled"),
    "run_status": (
        run_status,
        f"""WITH {_STAGES_SQL}, s AS (SELECT *, CASE WHEN stage = 'candidates' AND run_id % 9 = 0 THEN 'empty' ELSE stage_status END AS st FROM rolled)
SELECT run_id, CASE WHEN bool_or(stage = 'candidates' AND st = 'empty') THEN 'empty' WHEN bool_or(st = 'failed' AND stage <> 'delivery') THEN 'failed'
  WHEN bool_or(st = 'partial' OR partial_failure_count > 0 OR (st = 'failed' AND stage = 'delivery')) THEN 'partial' ELSE 'success' END AS run_status FROM s GROUP BY 1""",
    ),
    "error_codes": (
        error_codes,
        f"""WITH {_STAGES_SQL}, f AS (SELECT run_id, stage || '_' || status AS code, min(o_orderkey) AS first_at FROM papers WHERE status <> 'success' GROUP BY 1, 2)
SELECT run_id, string_agg(code, ',' ORDER BY first_at) AS error_codes FROM f GROUP BY 1""",
    ),
    "stage_contract": (
        stage_contract,
        f"""WITH {_STAGES_SQL}, s AS (SELECT *, CASE run_id % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE stage_status END AS st FROM rolled),
i AS (SELECT run_id, CASE WHEN st = 'success' AND partial_failure_count > 0 THEN 'success_with_failures'
  WHEN st = 'failed' AND (output_count > 0 OR partial_failure_count = 0) THEN 'failed_with_output' END AS code FROM s)
SELECT run_id, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1, 2""",
    ),
    "funnel_contract": (
        funnel_contract,
        f"""WITH {_STAGES_SQL}, c AS (SELECT run_id, count(*) FILTER (WHERE stage = 'candidates') AS a, count(*) FILTER (WHERE stage = 'documents') AS b,
  count(*) FILTER (WHERE stage = 'analysis') AS c, count(*) FILTER (WHERE stage = 'validation') AS d, count(*) FILTER (WHERE stage = 'delivery') AS e FROM papers GROUP BY 1)
SELECT run_id, 'selected_exceeds_candidates' AS code FROM c WHERE b > a UNION ALL SELECT run_id, 'analyzed_exceeds_selected' FROM c WHERE c > b
UNION ALL SELECT run_id, 'validated_exceeds_analyzed' FROM c WHERE d > c UNION ALL SELECT run_id, 'published_exceeds_validated' FROM c WHERE e > d
UNION ALL SELECT run_id, 'delivered_exceeds_validated' FROM c WHERE e > d""",
    ),
    "run_totals": (
        run_totals,
        "SELECT DISTINCT o_custkey AS run_id, 'partial_failure_count_total_mismatch' AS code FROM orders WHERE o_custkey % 10 = 3",
    ),
    "metric_reconcile": (
        metric_reconcile,
        f"""WITH {_STAGES_SQL}, m AS (SELECT run_id, stage, sum(o_orderkey) AS d FROM papers WHERE status <> 'partial' GROUP BY 1, 2)
SELECT stage, count(*) FILTER (WHERE d IS NULL) AS unmeasured, CAST(sum(d) AS BIGINT) AS duration_ns, CAST(sum(output_count) AS BIGINT) AS output_count
FROM m FULL JOIN rolled USING (run_id, stage) GROUP BY 1""",
    ),
    "budget_verdicts": (
        budget_verdicts,
        """WITH r AS (SELECT o_custkey AS run_id, count(*) AS candidate_count, count(*) FILTER (WHERE o_orderstatus = 'O') AS s, count(*) FILTER (WHERE o_orderstatus = 'P') AS a,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, count(*) FILTER (WHERE o_orderpriority <= '3') AS t, count(*) FILTER (WHERE o_totalprice > 499000) AS net,
  sum(CAST(floor(o_totalprice) AS BIGINT)) AS cost FROM orders GROUP BY 1)
SELECT run_id, candidate_count, CASE WHEN run_id % 2 = 0 THEN CAST(cost AS BIGINT) END AS estimated_cost_micro_usd,
  candidate_count <= 30 AND s <= 15 AND a <= 5 AND u <= 5 AND t <= 15 AND candidate_count * 2048 <= 40960 AND net = 0 AND cost * 64 <= 268435456
   AND (run_id % 2 = 1 OR cost <= 4500000) AS passed FROM r""",
    ),
    "cache_miss_join": (
        cache_miss_join,
        """WITH h AS (SELECT sha256('model-a' || chr(31) || text) AS key, min(doc_id) AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT doc_id, octet_length(encode(text)) AS value, coalesce(d % 10 <> 0, false) AS cache_hit FROM documents LEFT JOIN h ON key = sha256('model-a' || chr(31) || text)""",
    ),
    "cache_new_entries": (
        cache_new_entries,
        """WITH h AS (SELECT sha256('model-a' || chr(31) || text) AS key, min(doc_id) AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
a AS (SELECT DISTINCT sha256('model-a' || chr(31) || text) AS key, octet_length(encode(text)) AS value FROM documents)
SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM h WHERE d % 10 <> 0)""",
    ),
    "bundle_import": (
        bundle_import,
        f"""WITH {b.COMMANDS_SQL},
c AS (SELECT *, device_id || '-' || strftime(date_trunc('week', occurred_at), '%Y%m%d') AS bundle_id,
  row_number() OVER (ORDER BY occurred_at, CAST(device_id AS VARCHAR), sequence, CAST(command_id AS VARCHAR)) AS pos, action = 'set_read' AS reads FROM commands),
g AS (SELECT *, max(occurred_at) OVER (PARTITION BY bundle_id) AS generated_at FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY generated_at, bundle_id, pos) AS nth FROM g),
m AS (SELECT *, coalesce(pos <= max(pos) OVER (PARTITION BY paper_id, reads ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM o),
a AS (SELECT *, CASE WHEN action = 'set_favorite' THEN value WHEN action = 'set_irrelevant' AND value THEN false END AS fav,
  CASE WHEN action = 'set_irrelevant' THEN value WHEN action = 'set_favorite' AND value THEN false END AS irr FROM m WHERE NOT stale),
w AS (SELECT *, coalesce(last_value(CASE WHEN reads THEN value END IGNORE NULLS) OVER before, false) AS was_read,
  coalesce(last_value(fav IGNORE NULLS) OVER before, false) AS was_fav, coalesce(last_value(irr IGNORE NULLS) OVER before, false) AS was_irr
  FROM a WINDOW before AS (PARTITION BY paper_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT bundle_id, CASE WHEN reads THEN was_read <> value ELSE coalesce(fav, was_fav) <> was_fav OR coalesce(irr, was_irr) <> was_irr END AS changed,
  NOT reads AND value AND CASE WHEN action = 'set_favorite' THEN was_irr ELSE was_fav END AS conflict FROM w)
SELECT bundle_id, CAST(sum(applied) AS BIGINT) AS applied_count, CAST(sum(changed) AS BIGINT) AS changed_count, CAST(0 AS BIGINT) AS duplicate_count,
  CAST(sum(stale) AS BIGINT) AS stale_count, CAST(sum(conflict) AS BIGINT) AS conflict_count
FROM (SELECT bundle_id, 1 AS applied, CAST(changed AS INT) AS changed, 0 AS stale, CAST(conflict AS INT) AS conflict FROM e
  UNION ALL SELECT bundle_id, 0, 0, 1, 0 FROM m WHERE stale) GROUP BY bundle_id""",
    ),
    "incremental_run": (
        incremental_run,
        """WITH texts AS (SELECT text, bool_or(lang IN ('de', 'fr')) AS one, bool_or(lang <> 'es') AS two FROM documents GROUP BY text),
d AS (SELECT doc_id, lang, octet_length(encode(text)) AS n_bytes, one, two FROM documents JOIN texts USING (text))
SELECT 1 AS run, doc_id, n_bytes, false AS cache_hit FROM d WHERE lang IN ('de', 'fr')
UNION ALL SELECT 2, doc_id, n_bytes, one FROM d WHERE lang <> 'es'
UNION ALL SELECT 3, doc_id, n_bytes, two AND NOT one FROM d""",
    ),
    "usage_observation": (
        usage_observation,
        """WITH a AS (SELECT u.text, n.text AS answer, u.turn % 3 + 1 AS tries FROM conversations u
  LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 AND n.role = 'assistant' WHERE u.role = 'user')
SELECT CAST(sum(tries) AS BIGINT) AS attempt_count, CAST(sum(tries - 1) AS BIGINT) AS retry_count, count(*) FILTER (WHERE answer IS NULL) AS failed_count,
  CAST(sum(tries * ((octet_length(encode(text)) + 3) // 4)) AS BIGINT) AS input_tokens,
  CAST(sum((octet_length(encode(coalesce(answer, ''))) + 3) // 4) AS BIGINT) AS output_tokens, CAST(sum(tries * 125) AS BIGINT) AS cost_micro_usd FROM a""",
    ),
    "ledger_anti_join": (
        ledger_anti_join,
        """WITH l AS (SELECT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error' AND event_id % 5 = 0),
r AS (SELECT json_extract_string(props, '$.k') || CASE WHEN user_id % 3 = 0 THEN '-x' ELSE '' END AS delivery_key, event_id, ts, user_id FROM events WHERE event_type = 'purchase')
SELECT delivery_key, event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY ts, event_id) AS rn FROM r
  WHERE delivery_key NOT IN (SELECT k FROM l)) WHERE rn = 1""",
    ),
    "cache_freshness": (
        cache_freshness,
        """WITH n AS (SELECT max(ts) - INTERVAL 3 DAY AS now FROM events)
SELECT CASE WHEN ts > now THEN 'rejected' WHEN ts::DATE = now::DATE THEN 'fresh' WHEN ts >= now - INTERVAL 7 DAY THEN 'stale' ELSE 'expired' END AS state, count(*) AS n FROM events, n GROUP BY 1""",
    ),
    "stale_files": (
        stale_files,
        "SELECT 'papers/' || page_id || '.html' AS path FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    ),
    "artifact_totals": (
        artifact_totals,
        """SELECT source, count(*) AS file_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS byte_count,
  count(*) <= 50 AND sum(octet_length(encode(text))) <= 100000 AS within_limits FROM documents GROUP BY 1""",
    ),
}
