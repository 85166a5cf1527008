"""Observed model usage, and claims found at any depth."""

import json
import random

from pyspark.sql import functions as F

from lectern.operators import answers, usage

CALLS = [("a prompt", "an answer", 1), ("prompt", None, 3), (None, "", 2)]


def calls(spark):
    return spark.createDataFrame(CALLS, "prompt string, answer string, tries int")


def metrics():
    return usage.model_metrics(F.col("prompt"), F.col("answer"), F.col("tries"), F.col("tries") * 10)


def test_usage_comes_with_the_write(spark, tmp_path):
    write = lambda name: lambda rows: rows.write.parquet(f"{tmp_path}/{name}")
    context = spark.sparkContext

    def jobs(group, action):
        context.setJobGroup(group, group)
        result = action()
        context.setLocalProperty("spark.jobGroup.id", None)
        return result, len(context.statusTracker().getJobIdsForGroup(group))

    _, plain = jobs(f"plain-{tmp_path}", lambda: write("plain")(calls(spark)))
    seen, observed = jobs(f"observed-{tmp_path}", lambda: usage.observed_write(calls(spark), metrics(), write("observed")))
    assert plain == observed
    assert seen == {"attempt_count": 6, "retry_count": 3, "failed_count": 1, "input_tokens": 2 + 3 * 2, "output_tokens": 3, "cost_micro_usd": 60}
    empty = usage.observed_write(calls(spark).limit(0), metrics(), write("empty"))
    assert set(empty.values()) == {0}


def test_a_failing_observer_leaves_the_rows(spark, tmp_path):
    wrong = {"unresolved": F.sum("no_such_column"), "fails": F.sum(F.raise_error(F.lit("broken")).cast("int"))}
    for name, metric in wrong.items():
        write = lambda rows, name=name: rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        assert usage.observed_write(calls(spark), {name: metric}, write) is None
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 3


def test_usage_of_a_stream(spark, tmp_path):
    for k in range(3):
        calls(spark).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = usage.StreamUsage("model")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(calls(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        watched = stream.observe("model", *[c.alias(n) for n, c in metrics().items()])
        query = watched.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert listener.totals["attempt_count"] == 18 and len(listener.batches) >= 3
    finally:
        spark.streams.removeListener(listener)


def plain_claims(node, path="$"):
    if isinstance(node, dict):
        if set(answers.CLAIM_MEMBERS) <= set(node):
            yield path
        for key, child in node.items():
            yield from plain_claims(child, f"{path}.{key}")
    elif isinstance(node, list):
        for i, child in enumerate(node):
            yield from plain_claims(child, f"{path}[{i}]")


def random_node(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([None, 1, "x", True, [], {}])
    if kind < 0.5:
        return [random_node(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    node = {f"k{i}": random_node(rng, depth - 1) for i in range(rng.randint(0, 3))}
    for member in answers.CLAIM_MEMBERS:
        if rng.random() < 0.8:
            node[member] = rng.choice([None, "v", ["e1", "e2"], random_node(rng, depth - 1)])
    return node


def test_claims_at_any_depth(spark):
    rng = random.Random(5)
    payloads = [random_node(rng, 7) for _ in range(60)]
    deep = {"claim_id": "last", "kind": "k", "evidence_ids": ["e"]}
    for _ in range(60):
        deep = [{"in": deep}]
    payloads.append(deep)
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(900, None), (901, "no json {"), (902, "{}"), (903, '"x"')]
    got = answers.harvest_claims(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert sorted((r.id, r.path) for r in got) == sorted((i, p) for i, body in enumerate(payloads) for p in plain_claims(body))
    last = next(r for r in got if r.id == 60)
    assert (last.claim_id, last.kind, last.evidence_ids) == ("last", "k", ["e"])


def test_no_payloads(spark):
    got = answers.harvest_claims(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert got.columns == ["id", "path", "claim_id", "kind", "evidence_ids"] and got.count() == 0
