import pytest
from pyspark.sql import functions as F

from lectern.operators import caching, constraints, quality


def _rankings(spark, relevant, n=30):
    return spark.createDataFrame([("r", k, k in relevant) for k in range(1, n + 1)], "run string, rank int, relevant boolean")


def test_ranking_quality_values(spark):
    perfect = quality.ranking_quality(_rankings(spark, {1, 2, 3, 4, 5, 10}), ["run"]).first()
    assert (perfect.precision_at_5_ppm, perfect.recall_at_15_ppm, perfect.ndcg_at_5_ppm) == (1_000_000,) * 3
    other = quality.ranking_quality(_rankings(spark, {1, 2, 3, 4, 6, 20}), ["run"]).first()
    assert (other.precision_at_5_ppm, other.recall_at_15_ppm, other.ndcg_at_5_ppm) == (800_000, 833_333, 868_795)


def test_ranking_quality_refuses_short_and_gapped_input(spark):
    with pytest.raises(Exception, match="fifteen"):
        quality.ranking_quality(_rankings(spark, {1}, 14), ["run"]).collect()
    gapped = _rankings(spark, {1}).where("rank <> 7")
    with pytest.raises(Exception, match="every rank"):
        quality.ranking_quality(gapped, ["run"]).collect()
    with pytest.raises(Exception, match="denominator"):
        quality.ranking_quality(_rankings(spark, set()), ["run"]).collect()


def test_label_quality_values(spark):
    rows = [("evidence", True, True, False, False), ("evidence", True, False, False, False), ("evidence", True, False, False, False),
            ("evidence", False, True, False, False), ("claim", False, True, True, False), ("claim", False, True, False, False),
            ("claim", False, False, False, False), ("field", False, False, False, True), ("field", False, False, False, False),
            ("field", False, False, False, False)]
    df = spark.createDataFrame(rows, "domain string, expected boolean, accepted boolean, supported boolean, present boolean")
    got = quality.label_quality(df, []).first()
    assert (got.evidence_precision_ppm, got.evidence_recall_ppm) == (500_000, 333_333)
    assert (got.unsupported_claim_rate_ppm, got.missing_required_field_rate_ppm) == (500_000, 666_667)


def test_paired_comparison(spark):
    rows = [("x", "baseline", 1000 + k) for k in range(9)] + [("x", "improved", 800 + k) for k in range(9)]
    got = quality.paired_comparison(spark.createDataFrame(rows, "g string, variant string, ns long"), ["g"]).first()
    assert (got.baseline_median_ns, got.improved_median_ns, got.pair_count) == (1004, 804, 9)
    assert got.improvement_ppm == (200 * 1_000_000 + 502) // 1004 and got.passed
    slower = spark.createDataFrame([(g, v, n + (300 if v == "improved" else 0)) for g, v, n in rows], "g string, variant string, ns long")
    worse = quality.paired_comparison(slower, ["g"]).first()
    assert worse.improvement_ppm < 0 and not worse.passed


def test_optimization_target_breaks_ties(spark):
    rows = [("b", 400, 10, True), ("a", 400, 10, True), ("c", 900, 90, False), ("d", 100, 10, True)]
    df = spark.createDataFrame(rows, "symbol string, cumulative_time long, allocation_bytes long, eligible boolean")
    shared = quality.hot_spots(df, F.lit(1000), F.lit(0))
    assert quality.optimization_target(shared).first().symbol == "a"
    assert quality.optimization_target(shared, 500_000).count() == 0


def test_stage_and_run_status(spark):
    rows = [("r", "candidates", "success"), ("r", "documents", "partial"), ("r", "documents", "success"),
            ("r", "delivery", "failed"), ("s", "analysis", "failed"), ("s", "candidates", "success"), ("t", "candidates", "success")]
    rolled = quality.stage_rollup(spark.createDataFrame(rows, "run string, stage string, status string"), ["run", "stage"])
    got = {(r.run, r.stage): r.stage_status for r in rolled.collect()}
    assert got[("r", "documents")] == "partial" and got[("r", "delivery")] == "failed" and got[("t", "candidates")] == "success"
    status = {r.run: r.run_status for r in quality.run_status(rolled.withColumn("status", F.col("stage_status")), "run").collect()}
    assert status == {"r": "partial", "s": "failed", "t": "success"}


def test_first_seen_codes(spark):
    df = spark.createDataFrame([("r", "b", 1), ("r", "a", 2), ("r", "b", 3), ("r", None, 0)], "run string, code string, pos int")
    assert quality.first_seen_codes(df, ["run"], "code", "pos").first().error_codes == ["b", "a"]


def test_budget(spark):
    inside = {name: 0 for name in quality.BUDGET_LIMITS}
    schema = ", ".join(f"{n} long" for n in inside) + ", maximum_batch_cost_micro_usd long, estimated_cost_micro_usd long"
    rows = [tuple(quality.BUDGET_LIMITS.values()) + (None, None)]
    rows += [tuple(inside.values()) + cost for cost in ((10, 10), (10, 11), (10, None))]
    rows += [tuple(v + (n == k) for n, v in quality.BUDGET_LIMITS.items()) + (None, None) for k in quality.BUDGET_LIMITS]
    got = [r.passed for r in quality.budget_verdict(spark.createDataFrame(rows, schema)).collect()]
    assert got == [True, True, False, False] + [False] * len(inside)


def test_stage_contract_has_one_code_per_break(spark):
    def row(status, output=0, failures=0, codes=(), given=0, hits=0):
        return ("r", "documents", status, given, output, hits, 0, failures, list(codes))

    rows = [row("success", 1), row("success", 1, 1), row("partial", 1), row("partial", 1, 1), row("failed", 0, 0, ["x"]), row("failed"),
            row("empty"), row("empty", 1), row("skipped"), row("skipped", given=2), row("skipped", given=2, codes=["x"]), row("skipped", hits=1)]
    df = spark.createDataFrame(
        rows, "run_id string, stage string, status string, input_count int, output_count int, cache_hit_count int, "
        "retry_count int, partial_failure_count int, error_codes array<string>")
    codes = sorted(r.code for r in constraints.stage_issues(df).collect())
    assert codes == sorted(["success_with_failures", "partial_without_failure", "failed_with_output", "empty_with_output",
                            "skipped_with_work", "skipped_with_work"])


def test_funnel_and_totals(spark):
    counts = spark.createDataFrame([("r", 1, 2, 3, 4, 5, 5), ("ok", 5, 4, 3, 2, 1, 2)], "run string, candidate_count int, selected_count int, "
                                   "analyzed_count int, validated_count int, published_count int, delivered_count int")
    issues = constraints.funnel_issues(counts, "run").collect()
    assert len(issues) == 5 and {i.paper_id for i in issues} == {"r"}
    stages = spark.createDataFrame([("r", 1), ("r", 2)], "run string, n long")
    totals = spark.createDataFrame([("r", 3), ("s", 0), ("t", 1)], "run string, n long")
    assert [(i.code, i.paper_id) for i in constraints.total_issues(totals, stages, "run", ["n"]).collect()] == [("n_total_mismatch", "t")]


def test_cache_computes_each_missing_key_once(spark):
    inputs = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "b", "c", "c"])], "id int, text string").withColumn(
        "key", caching.cache_key(F.col("text"), "m1"))
    cache = inputs.where("text IN ('a', 'c')").select("key", F.lit(7).alias("value")).distinct()
    cache = cache.withColumn("payload_hash", F.sha2(F.to_json(F.struct("value")), 256))
    broken = inputs.where("text = 'c'").select("key").distinct().withColumn("bad", F.lit(True))
    cache = cache.join(broken, "key", "left").withColumn("payload_hash", F.when(F.col("bad"), "x").otherwise(F.col("payload_hash"))).drop("bad")
    results, entries = caching.with_cache(inputs, cache, "key", lambda m: m.withColumn("value", F.lit(9)), "value")
    got = {r.id: (r.value, r.cache_hit) for r in results.collect()}
    assert got == {0: (7, True), 1: (9, False), 2: (9, False), 3: (9, False), 4: (9, False)}
    assert entries.count() == 2
    twice = cache.unionByName(cache)
    assert caching.with_cache(inputs, twice, "key", lambda m: m.withColumn("value", F.lit(9)), "value")[0].count() == 5
    calls = spark.sparkContext.accumulator(0)

    def counted(missing):
        def work(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch[["key"]].assign(value=9)

        return missing.mapInPandas(work, "key string, value int")

    results, entries = caching.with_cache(inputs, cache, "key", counted, "value")
    assert (results.count(), entries.count(), calls.value) == (5, 2, 2)
    other = inputs.withColumn("key", caching.cache_key(F.col("text"), "m2"))
    assert other.join(cache, "key").count() == 0


def test_freshness(spark):
    rows = [("2024-01-10 01:00:00", "fresh"), ("2024-01-10 13:00:00", "rejected"), ("2024-01-04 00:00:00", "stale"), ("2024-01-01 00:00:00", "expired")]
    df = spark.createDataFrame(rows, "at string, expected string").withColumn("at", F.to_timestamp("at"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    assert all(r.state == r.expected for r in df.withColumn("state", caching.freshness(F.col("at"), now, 7)).collect())
