"""The daily run as one composition of DataFrames, from interests and entries to a manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as t
from lectern.operators import answers, evidence, feedback, hierarchy, outline, quality, ranking, validation
from lectern.operators.caching import cache_key
from lectern.operators.dedup import set_fingerprint
from lectern.operators.result_store import ResultStore, reuse
from lectern.session import materialize
from lectern.sinks import read_batch, write_batch, write_manifest
from lectern.sources.feeds import in_categories, latest_entries


@dataclass(frozen=True)
class RunSettings:
    run_id: str
    include_paths: tuple[str, ...]
    exclude_paths: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    include_cross_list: bool = False
    focus_query: str | None = None
    focus_weight: float = 0.6
    focus_minimum: float = 0.0
    favorite_delta: float = 0.05
    pool: int = 30
    shortlist: int = 15
    full: int = 5
    allow_partial: bool = False
    scorer: str = "recency"


@dataclass(frozen=True)
class Stores:
    """Results of earlier runs and what they depend on beside their inputs.

    ``embeddings`` holds ``array<double>``, ``answers`` and ``reports`` hold strings.  The
    identities name models, prompts and rules with their versions and settings.
    """

    embeddings: ResultStore
    answers: ResultStore
    reports: ResultStore
    now: datetime
    embedding_identity: str
    answer_identity: str
    rules_identity: str
    ttl_days: float | None = 7

    def embed(self, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def stored(rows: DataFrame) -> DataFrame:
            keyed = rows.withColumn("_key", cache_key(F.col("text"), self.embedding_identity))
            found = reuse(keyed, "_key", self.embeddings, embed, "embedding", self.now, self.ttl_days)
            return found.select(*rows.columns, "embedding")

        return stored

    def answer(self, answer: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def stored(packets: DataFrame) -> DataFrame:
            shown = evidence.packet_fingerprints(packets).select(
                F.col("doc_id").alias("paper_id"), cache_key(F.concat_ws("\x1f", "doc_id", "packet_fingerprint"), self.answer_identity).alias("_key")
            )

            def ask(missing: DataFrame) -> DataFrame:
                wanted = packets.join(missing.select(F.col("paper_id").alias("doc_id")), "doc_id", "left_semi")
                return answer(wanted).join(missing.select("paper_id", "_key"), "paper_id")

            found = reuse(shown, "_key", self.answers, ask, "answer", self.now, self.ttl_days)
            return found.where("answer IS NOT NULL").select("paper_id", "answer")

        return stored

    def validate(self, answers_df: DataFrame, packet: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """:func:`validated` for papers whose answer, packet or rules are new."""
        report_like, issue_like = validated(answers_df, packet)
        shape = f"struct<report: {report_like.schema.simpleString()}, issues: array<{issue_like.schema.simpleString()}>>"
        prints = evidence.packet_fingerprints(packets).select(F.col("doc_id").alias("paper_id"), "packet_fingerprint")
        given = answers_df.join(prints, "paper_id", "left").withColumn(
            "_key",
            cache_key(F.concat_ws("\x1f", "paper_id", F.coalesce("packet_fingerprint", F.lit("")), "answer"), self.rules_identity),
        )

        def check(missing: DataFrame) -> DataFrame:
            reports, issues = validated(missing.select("paper_id", "answer"), packet)
            listed = issues.groupBy("paper_id").agg(F.collect_list(F.struct(*issues.columns)).alias("issues"))
            whole = reports.select("paper_id", F.struct(*reports.columns).alias("report")).join(listed, "paper_id", "left")
            kept = whole.select("paper_id", F.to_json(F.struct("report", F.coalesce("issues", F.array()).alias("issues"))).alias("checked"))
            return kept.join(missing.select("paper_id", "_key"), "paper_id")

        found = reuse(given, "_key", self.reports, check, "checked", self.now, self.ttl_days)
        read = found.select(F.from_json("checked", shape).alias("r"))
        return read.select("r.report.*"), read.select(F.explode("r.issues").alias("i")).select("i.*")


def interest_corpus(collections: DataFrame, items: DataFrame, settings: RunSettings) -> DataFrame:
    """Library items with their paths and a verdict: eligible, excluded or invalid."""
    paths = hierarchy.ancestor_paths(collections, "key", "parent_key", "name")
    placed = hierarchy.item_paths(items, "key", "collection_keys", paths, "key")
    joined = items.join(placed, "key")
    complete = t.not_blank(F.col("key")) & t.not_blank(F.col("title")) & t.not_blank(F.col("abstract"))
    included = F.exists("paths", lambda p: t.matches_any(p, list(settings.include_paths)))
    excluded = F.exists("paths", lambda p: t.matches_any(p, list(settings.exclude_paths)))
    verdict = (
        F.when(~complete, "invalid")
        .when((F.size("paths") == 0) & (F.col("listed_keys") > 0), "invalid")
        .when(included & ~excluded, "eligible")
        .otherwise("excluded")
    )
    return joined.select(
        F.concat(F.lit("zotero:"), F.trim("key")).alias("paper_id"),
        "title", "abstract", "paths", "added_at", "broken_keys", verdict.alias("verdict"),
    )


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    fields = F.concat_ws("\x1f", "paper_id", "title", "abstract", F.array_join("paths", "|"), F.col("added_at").cast("string"))
    return set_fingerprint(corpus.select(F.sha2(fields, 256).alias("d")), F.col("d"))


def candidate_batch(
    corpus: DataFrame,
    entries: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    state: DataFrame | None,
    settings: RunSettings,
) -> DataFrame:
    """Ranked candidates; ``embed`` adds ``embedding`` to rows that carry ``text``."""
    current = latest_entries(in_categories(entries, settings.categories, settings.include_cross_list))
    candidates = current.withColumn("feedback_id", t.feedback_paper_id(F.col("arxiv_id")))
    if state is None:
        candidates = candidates.withColumn("is_favorite", F.lit(False))
    else:
        marks = state.withColumnRenamed("paper_id", "feedback_id")
        candidates = ranking.feedback_flags(candidates, marks, "feedback_id").where("NOT is_irrelevant")
    text = ranking.ranking_text(F.col("title"), F.col("abstract")).alias("text")
    interests = embed(
        corpus.where("verdict = 'eligible'").select("paper_id", "added_at", text)
    )
    embedded = embed(candidates.select("*", text))
    scored = ranking.scorer(settings.scorer)(embedded, interests, "added_at", "paper_id", "embedding")
    score = "corpus_score"
    if settings.focus_query is not None:
        query = corpus.sparkSession.createDataFrame([(settings.focus_query,)], "text string")
        scored = ranking.focus_blend(scored, embed(query), "embedding", settings.focus_weight, settings.focus_minimum)
        score = "blended_score"
    adjusted = ranking.favorite_bonus(scored, score, settings.favorite_delta)
    return ranking.ranked_prefixes(
        adjusted, "final_score", "paper_id", settings.pool, settings.shortlist, settings.full
    ).drop("embedding", "text")


def selected(df: DataFrame, batch: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of the papers chosen for full analysis, before any costly step; at most a handful of papers."""
    chosen = batch.where("in_full_analysis").select(F.col("paper_id").alias(key), "rank")
    return df.join(chosen, key)


def ordered_selection(batch: DataFrame, ids: list[str]) -> DataFrame:
    """Candidates in the order of an explicit id list; an unknown id stops the job."""
    spark = batch.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, paper_id string")
    joined = wanted.join(batch.withColumn("_known", F.lit(True)), "paper_id", "left")
    checked = F.when(F.col("_known"), F.col("pos")).otherwise(
        F.raise_error(F.concat(F.lit("unknown paper id "), "paper_id")).cast("int")
    )
    return joined.withColumn("pos", checked).drop("_known").orderBy("pos")


def packet_sources(items: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text blocks and captioned visuals of documents given as parsed items and page sizes."""
    placed = materialize(outline.outline(outline.place_boxes(items, pages)))
    blocks = placed.where("mapped").withColumn("block_type", outline.block_type(F.col("label")))
    visuals = placed.where(F.col("box").isNotNull() & outline.is_visual(F.col("label"))).withColumn(
        "kind", F.when(F.lower("label") == "table", "table").otherwise("figure")
    )
    captions = outline.visual_captions(visuals, placed)
    with_caption = visuals.join(captions.select("doc_id", "pos", "caption"), ["doc_id", "pos"], "left")
    return blocks, with_caption


def evidence_packets(items: DataFrame, pages: DataFrame, limits: evidence.PacketLimits) -> DataFrame:
    """Packets of documents given as parsed items and page sizes."""
    return evidence.packets(*packet_sources(items, pages), limits)


def validated(answers_df: DataFrame, packet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and issues for model answers (paper_id, answer) checked against packets."""
    parsed = answers.parse(answers_df, "answer")
    located = answers.claim_locations(
        parsed.select(F.col("paper_id").alias("_paper"), "analysis", "failure"), "_paper"
    ).withColumnRenamed("_paper", "paper_id")
    claims = located.select(
        "paper_id", "claim_pos", "claim_id", "kind", "expected_kind", "source_type", "inferred"
    )
    edges = located.select("paper_id", "claim_pos", F.explode("evidence_ids").alias("evidence_id"))
    facts = validation.claim_facts(claims, edges, packet)
    every_paper = parsed.where("analysis IS NOT NULL").select("paper_id").join(
        claims.select("paper_id", "expected_kind"), "paper_id", "left"
    )
    issues = validation.claim_issues(facts, edges, packet).unionByName(validation.missing_insight(every_paper))
    status = F.when(F.col("failure").isNotNull(), "failed").otherwise("success")
    papers = parsed.select("paper_id", status.alias("analysis_status"))
    return validation.report_status(papers, issues), issues


STAGES = ("candidates", "documents", "analysis", "validation", "publication")
STAGE_ROW = "stage string, status string, input_count long, output_count long, partial_failure_count long"


def run(
    tables: dict[str, DataFrame],
    embed: Callable[[DataFrame], DataFrame],
    answer: Callable[[DataFrame], DataFrame],
    settings: RunSettings,
    output: str,
    limits: evidence.PacketLimits,
    stores: Stores | None = None,
) -> DataFrame:
    """Run every stage, write each result under ``output`` and return the manifest row.

    ``tables`` holds collections, items, entries, document_items and document_pages
    (keyed by paper in ``doc_id``) and optionally commands.  ``answer`` turns packets
    into rows (paper_id, answer).  A stage that raises is failed and the later ones
    are skipped; a paper that fails only makes its stage partial.  What ``limits`` cut is
    written beside the packets.  With ``stores``, embeddings, answers and reports of earlier
    runs are used where nothing they depend on has changed, and new ones are added.
    """
    if stores is not None:
        embed, answer = stores.embed(embed), stores.answer(answer)
    spark = tables["items"].sparkSession
    run_id = settings.run_id
    done: list[tuple] = []
    results: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        write_batch(df, f"{output}/{name}", run_id)
        results[name] = read_batch(spark, f"{output}/{name}", run_id)
        return results[name]

    def papers(df: DataFrame, key: str = "paper_id") -> int:
        return df.select(key).distinct().count()

    def candidates() -> tuple[int, int]:
        corpus = interest_corpus(tables["collections"], tables["items"], settings)
        state = feedback.replay(tables["commands"]) if "commands" in tables else None
        batch = keep("candidates", candidate_batch(corpus, tables["entries"], embed, state, settings))
        return tables["entries"].count(), batch.count()

    def documents() -> tuple[int, int]:
        items = selected(tables["document_items"], results["candidates"], "doc_id").drop("rank")
        blocks, visuals = packet_sources(items, tables["document_pages"])
        packet = keep("packets", evidence.packets(blocks, visuals, limits))
        keep("packet_cuts", evidence.packet_cuts(blocks, visuals, packet))
        return selection(), papers(packet, "doc_id")

    def analysis() -> tuple[int, int]:
        given = keep("answers", answer(results["packets"]))
        parsed = answers.parse(given.select("paper_id", "answer"), "answer")
        return papers(results["packets"], "doc_id"), parsed.where("failure IS NULL").count()

    def validate() -> tuple[int, int]:
        packet = results["packets"].select(
            F.col("doc_id").alias("paper_id"), "evidence_id", "kind", "abstract_only", F.col("place").alias("pos")
        )
        given = results["answers"].select("paper_id", "answer")
        reports, issues = validated(given, packet) if stores is None else stores.validate(given, packet, results["packets"])
        keep("issues", issues)
        kept = keep("reports", reports)
        return kept.count(), kept.where("result_status = 'validated'").count()

    def publish() -> tuple[int, int]:
        decisions = keep("decisions", validation.publication(results["reports"].drop("run_id"), settings.allow_partial))
        published = decisions.where("decision <> 'excluded'").count()
        return results["reports"].where("publication_eligibility = 'eligible'").count(), published

    def selection() -> int:
        return results["candidates"].where("in_full_analysis").count()

    failure: Exception | None = None
    for name, step in zip(STAGES, (candidates, documents, analysis, validate, publish), strict=True):
        if done and done[-1][1] in ("failed", "empty", "skipped"):
            done.append((name, "skipped", 0, 0, 0))
            continue
        try:
            given, produced = step()
        except Exception as error:  # noqa: BLE001 - any failure ends the run, the manifest tells where
            failure = failure or error
            done.append((name, "failed", 0, 0, 0))
            continue
        if name == "candidates":
            done.append((name, "success" if produced else "empty", given, produced, 0))
        else:
            lost = max(given - produced, 0)
            status = "failed" if produced == 0 and given else "partial" if lost else "success"
            done.append((name, status, given, produced, lost))
    row = manifest(spark.createDataFrame(done, STAGE_ROW), run_id).withColumn(
        "failure", F.lit(type(failure).__name__ if failure else None).cast("string")
    )
    write_manifest(row.drop("run_id"), f"{output}/manifest", run_id)
    return row


def manifest(stages: DataFrame, run_id: str) -> DataFrame:
    """One row: run status and totals over the stage rows of a run."""
    totals = stages.agg(
        F.sum("input_count").alias("input_count"),
        F.sum("output_count").alias("output_count"),
        F.sum("partial_failure_count").alias("partial_failure_count"),
    )
    status = quality.run_status(stages.withColumn("run_id", F.lit(run_id)), "run_id")
    return status.select(
        "run_id", "run_status",
        *[totals.select(c).scalar().alias(c) for c in totals.columns],
    )
