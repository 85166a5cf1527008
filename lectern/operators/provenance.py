"""Whether text evidence still says what its source block says, term by term.

A candidate's terms are the bits of a mask.  Those about the block are judged right after
the join with it, so that no text goes into the second join, with the sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import abstract_only, normalized_title
from lectern.operators.constraints import differs, row_issues
from lectern.operators.outline import TEXT_BLOCKS

BLOCK_TERMS = (
    "block_type", "evidence_text", "text_start", "pdf_page", "section_id", "visual_id", "label", "caption", "one_region",
    "region_page", "region_box", "region_image", "region_source", "region_confidence", "confidence",
)
SECTION_TERMS = ("section_title", "section_path", "abstract_only")
TERMS = BLOCK_TERMS + SECTION_TERMS


def _bits(broken: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for term, wrong in broken.items():
        mask = mask.bitwiseOR(F.when(F.coalesce(wrong, F.lit(False)), 1 << TERMS.index(term)).otherwise(0))
    return mask


def text_terms(evidence: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, evidence_id, known, mask`` of text evidence; bit k stands for ``TERMS[k]``.

    ``evidence`` has block_ids, evidence_text, pdf_page, section_id, section_title, section_path,
    visual_id, label, caption, regions, confidence and abstract_only; a region is a struct of
    pdf_page, box, image_path, source and confidence.  ``blocks`` has block_id, block_type, text,
    pdf_page, box, section_id and source, whose field confidence is the block's; ``sections`` has
    section_id, title and section_path, the titles from the root.  Blocks and sections are unique
    per document.  Evidence that does not name exactly one block of its document is not known and
    has mask 0.  A block without a known section has no title, an empty path and is no abstract;
    texts are compared in code points, and null and empty evidence text both break evidence_text.
    """
    source = blocks.select("doc_id", F.col("block_id").alias("_block"), F.struct("block_type", "text", "pdf_page", "box", "section_id", "source").alias("_b"))
    named = evidence.withColumn("_block", F.when(F.size("block_ids") == 1, F.get("block_ids", F.lit(0))))
    joined = named.join(source, ["doc_id", "_block"], "left")
    region = F.when(F.size("regions") == 1, F.get("regions", F.lit(0)))
    text = F.coalesce("evidence_text", F.lit(""))
    of_block = {
        "block_type": ~F.coalesce(F.col("_b.block_type").isin(*TEXT_BLOCKS), F.lit(False)),
        "evidence_text": text == "",
        "text_start": ~F.coalesce(F.col("_b.text").startswith(text), F.lit(False)),
        "pdf_page": differs(F.col("pdf_page"), F.col("_b.pdf_page")),
        "section_id": differs(F.col("section_id"), F.col("_b.section_id")),
        "visual_id": F.col("visual_id").isNotNull(),
        "label": F.col("label").isNotNull(),
        "caption": F.col("caption").isNotNull(),
        "one_region": region.isNull(),
        "region_page": region.isNotNull() & differs(region["pdf_page"], F.col("_b.pdf_page")),
        "region_box": region.isNotNull() & differs(region["box"], F.col("_b.box")),
        "region_image": region["image_path"].isNotNull(),
        "region_source": region.isNotNull() & differs(region["source"], F.col("_b.source")),
        "region_confidence": region.isNotNull() & differs(region["confidence"], F.col("_b.source.confidence")),
        "confidence": differs(F.col("confidence"), F.col("_b.source.confidence")),
    }
    judged = joined.select(
        "doc_id", "evidence_id", F.col("_b").isNotNull().alias("known"), _bits(of_block).alias("_mask"),
        F.col("_b.section_id").alias("_section"), "section_title", "section_path", F.col("abstract_only").alias("_abstract"),
    )
    facts = sections.select("doc_id", F.col("section_id").alias("_section"), F.col("title").alias("_title"), F.col("section_path").alias("_path"))
    path = F.coalesce("_path", F.array().cast("array<string>"))
    of_section = {
        "section_title": differs(F.col("section_title"), F.col("_title")),
        "section_path": differs(F.col("section_path"), path),
        "abstract_only": differs(F.col("_abstract"), abstract_only(F.transform(path, normalized_title))),
    }
    both = judged.join(facts, ["doc_id", "_section"], "left")
    return both.select(
        "doc_id", "evidence_id", "known", F.when(F.col("known"), F.col("_mask").bitwiseOR(_bits(of_section))).otherwise(0).alias("mask")
    )


def broken_terms(mask: Column) -> Column:
    """Names of the terms of a mask, in the order of ``TERMS``."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << k) != 0, term) for k, term in enumerate(TERMS)]))


def text_issues(terms: DataFrame) -> DataFrame:
    """Issue rows: evidence_source_missing, or text_provenance_mismatch where any term is broken."""
    return row_issues(
        terms, {"evidence_source_missing": ~F.col("known"), "text_provenance_mismatch": F.col("mask") != 0},
        paper_id="doc_id", evidence_id=F.col("evidence_id"), field_path=F.lit("evidence_candidates"),
    )
