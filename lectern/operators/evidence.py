"""Bounded evidence packets from placed document blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import abstract_only, not_blank, section_priority, visual_label
from lectern.operators.outline import TEXT_BLOCKS

ORDER = ["priority", "pdf_page", "kind_order", "reading_order", "stable_id"]


@dataclass(frozen=True)
class PacketLimits:
    """What a packet may hold; ``max_chars`` and ``max_block_chars`` None leave texts whole."""

    max_candidates: int = 48
    max_chars: int | None = 24_000
    max_block_chars: int | None = 2_000
    max_visuals: int = 3


UNCUT = PacketLimits(max_chars=None, max_block_chars=None)


def evidence_id(document: Column, kind: Column, pos: Column, page: Column, box: Column) -> Column:
    parts = F.concat_ws(
        "\x1f", document.cast("string"), kind, pos.cast("string"), page.cast("string"),
        *[box[c].cast("bigint").cast("string") for c in ("left", "top", "right", "bottom")],
    )
    return F.concat(F.lit("ev-"), F.substring(F.sha2(parts, 256), 1, 24))


def _with_path(df: DataFrame) -> DataFrame:
    keys = F.col("section_keys")
    return df.select("*", section_priority(keys).alias("priority"), abstract_only(keys).alias("abstract_only"))


def text_candidates(blocks: DataFrame, limits: PacketLimits) -> DataFrame:
    whole = F.col("text")
    cut = whole if limits.max_block_chars is None else F.substring(whole, 1, limits.max_block_chars)
    kept = blocks.where(F.col("block_type").isin(*TEXT_BLOCKS) & not_blank(cut))
    return _with_path(kept).select(
        "doc_id",
        evidence_id(F.col("doc_id"), F.lit("text"), F.col("pos"), F.col("pdf_page"), F.col("box")).alias("evidence_id"),
        F.lit("text").alias("kind"),
        "priority", "pdf_page",
        F.lit(0).alias("kind_order"),
        F.col("pos").alias("reading_order"),
        cut.alias("evidence_text"),
        F.lit(None).cast("string").alias("label"),
        "abstract_only",
    ).withColumn("stable_id", F.col("evidence_id"))


def visual_candidates(visuals: DataFrame) -> DataFrame:
    """``visuals`` carry doc_id, pos, kind, pdf_page, box, section_keys and caption."""
    return _with_path(visuals).select(
        "doc_id",
        evidence_id(F.col("doc_id"), F.col("kind"), F.col("pos"), F.col("pdf_page"), F.col("box")).alias("evidence_id"),
        "kind",
        "priority", "pdf_page",
        F.lit(1).alias("kind_order"),
        F.lit(0).cast("bigint").alias("reading_order"),
        F.col("caption").alias("evidence_text"),
        visual_label(F.col("caption"), F.col("kind")).alias("label"),
        "abstract_only",
    ).withColumn("stable_id", F.col("evidence_id"))


def reserve_visuals(candidates: DataFrame, limits: PacketLimits) -> DataFrame:
    """The best few visuals per document, then text up to the remaining places.

    The rank filter is a plain ``<=`` so that Spark cuts each map task's rows per
    document before the shuffle.
    """
    per_kind = Window.partitionBy("doc_id", "kind_order").orderBy(*ORDER)
    quota = F.when(F.col("kind_order") == 1, min(limits.max_visuals, limits.max_candidates)).otherwise(
        limits.max_candidates
    )
    best = (
        candidates.withColumn("_rank", F.row_number().over(per_kind))
        .where(F.col("_rank") <= limits.max_candidates)
        .where(F.col("_rank") <= quota)
    )
    visuals = F.count_if(F.col("kind_order") == 1).over(Window.partitionBy("doc_id"))
    return (
        best.withColumn("_visuals", visuals)
        .where((F.col("kind_order") == 1) | (F.col("_rank") <= limits.max_candidates - F.col("_visuals")))
        .drop("_rank", "_visuals")
    )


def character_budget(chosen: DataFrame, limits: PacketLimits) -> DataFrame:
    """Cut texts to a running budget: exhausted text rows go, visuals stay without text.

    A document has at most ``max_candidates`` rows here.
    """
    if limits.max_chars is None:
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER)).cast("bigint")
        return chosen.withColumn("place", number)
    before = F.sum(F.length("evidence_text")).over(
        Window.partitionBy("doc_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.greatest(F.lit(limits.max_chars) - F.coalesce(before, F.lit(0)), F.lit(0)).cast("int")
    cut = chosen.withColumn("_left", left).where(
        (F.col("kind_order") == 1) | (F.col("_left") > 0)
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER)).cast("bigint")
    text = F.when(F.col("_left") > 0, F.substring(F.col("evidence_text"), F.lit(1), F.col("_left")))
    return cut.withColumn("evidence_text", text).withColumn("place", place).drop("_left")


def packet_cuts(blocks: DataFrame, visuals: DataFrame, packet: DataFrame) -> DataFrame:
    """How many rows and characters each document lost on the way into its packet."""
    offered = text_candidates(blocks, UNCUT).unionByName(visual_candidates(visuals))

    def sizes(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(
            F.count("*").alias(f"{prefix}_rows"), F.sum(F.length("evidence_text")).alias(f"{prefix}_chars")
        )

    lost = lambda what: (F.coalesce(f"offered_{what}", F.lit(0)) - F.coalesce(f"packed_{what}", F.lit(0))).alias(f"cut_{what}")
    return sizes(offered, "offered").join(sizes(packet, "packed"), "doc_id", "left").select("doc_id", lost("rows"), lost("chars"))


def packets(blocks: DataFrame, visuals: DataFrame, limits: PacketLimits) -> DataFrame:
    candidates = text_candidates(blocks, limits).unionByName(visual_candidates(visuals))
    return character_budget(reserve_visuals(candidates, limits), limits)


def packet_fingerprints(packet: DataFrame) -> DataFrame:
    """One digest per packet over its rows in place order; a packet is small by construction."""
    row = F.concat_ws(
        "\x1f", "evidence_id", "kind", F.col("pdf_page").cast("string"), F.coalesce("evidence_text", F.lit(""))
    )
    rows = F.array_sort(F.collect_list(F.struct("place", F.sha2(row, 256).alias("d"))))
    return packet.groupBy("doc_id").agg(
        F.count("*").alias("candidate_count"),
        F.sha2(F.array_join(F.transform(rows, lambda e: e["d"]), "|"), 256).alias("packet_fingerprint"),
    )


def prompt_payloads(packet: DataFrame) -> DataFrame:
    """Per document the evidence a model sees, as a JSON list in place order."""
    shown = F.struct("place", "evidence_id", "kind", "pdf_page", "label", "abstract_only", "evidence_text")
    rows = F.array_sort(F.collect_list(shown))
    return packet.groupBy("doc_id").agg(
        F.count("*").alias("candidate_count"), F.to_json(rows).alias("payload")
    )
