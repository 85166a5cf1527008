"""The rules of document graphs and of text evidence over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import document_rules, provenance
from lectern.plans import bindings as b
from lectern.session import materialize

LOST = 100_000_000


def document_graph(spark, folder) -> document_rules.Graph:
    """Every line is a block of a page of 30 lines and a section of 10; every 23rd is a visual too.

    Ids, boxes, memberships, parents and sources are broken in places that follow from the
    position, so that most rules are broken somewhere.
    """
    pos, doc = F.col("pos"), F.col("doc_id")
    lines = materialize(b.lines(spark, folder).where("doc_id IS NOT NULL").select("doc_id", "pos", F.length("line").alias("n")))
    page, own = F.floor(pos / 30) + 1, F.floor(pos / 10)

    def source(on, box):
        return F.struct(on.alias("pdf_page"), box.alias("box"), F.lit("lines").alias("parser"), F.lit("1").alias("parser_version"))

    def box(right):
        return F.struct(F.lit(10.0).alias("left"), F.lit(5.0).alias("top"), right.cast("double").alias("right"), F.lit(20.0).alias("bottom"))

    wide = box(11 + F.col("n") % 700)
    per_doc = lines.groupBy("doc_id").agg(F.max(page).alias("last"))
    documents = per_doc.select(
        "doc_id", (F.col("last") + (doc % 10 == 4).cast("int")).alias("page_count"), F.lit("lines").alias("parser"),
        F.when(doc % 10 == 3, "2").otherwise("1").alias("parser_version"), F.lit("/evidence").alias("evidence_root"),
    )
    pages = lines.select("doc_id", page.alias("pdf_page")).distinct().select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    block = lines.select(
        "doc_id", pos.alias("block_id"), F.when((pos % 23 == 9) & (F.col("n") % 3 > 0), "caption").otherwise("text").alias("block_type"),
        page.alias("pdf_page"), wide.alias("box"), F.when(pos % 29 == 7, own + LOST).otherwise(own).alias("section_id"),
        source(F.when(pos % 37 == 6, page + 1).otherwise(page), wide).alias("source"),
    )
    again = block.where("block_id % 53 = 9")
    section = lines.groupBy("doc_id", own.alias("section_id")).agg(F.min(page).alias("start"), F.max(page).alias("end"))
    s = F.col("section_id")
    parent = F.when(s % 7 == 3, s).when(s % 5 == 1, s + LOST).when(s > 0, F.floor((s - 1) / 3))
    regular = lines.where("pos % 23 = 8")
    refers = regular.where("pos % 46 <> 8")
    on = F.when(pos % 3 == 1, page + LOST).otherwise(page)
    return document_rules.Graph(
        documents=documents,
        pages=pages,
        page_blocks=lines.where("pos % 31 <> 4").select("doc_id", page.alias("pdf_page"), pos.alias("block_id")).unionByName(
            lines.where("pos % 41 = 5").select("doc_id", page.alias("pdf_page"), (-pos).alias("block_id"))
        ),
        blocks=block.unionByName(again),
        sections=section.select(
            "doc_id", "section_id", parent.alias("parent_id"), F.col("start").alias("start_pdf_page"),
            (F.col("end") + (s % 11 == 2).cast("int")).alias("end_pdf_page"),
            source(F.col("start"), F.when(s % 13 != 4, box(F.lit(30)))).alias("source"),
        ),
        section_blocks=lines.select("doc_id", own.alias("section_id"), pos.alias("block_id")),
        visuals=regular.select("doc_id", pos.alias("visual_id"), F.when(pos % 5 == 2, own + LOST).otherwise(own).alias("section_id"), F.lit("Figure").alias("caption")),
        caption_blocks=refers.select("doc_id", pos.alias("visual_id"), (pos + 1).alias("block_id")),
        regions=regular.select(
            "doc_id", pos.alias("visual_id"), F.lit(0).alias("nth"), on.alias("pdf_page"), box(F.lit(30)).alias("box"),
            source(F.when(pos % 7 == 1, page + 1).otherwise(on), box(F.lit(30))).alias("source"),
            F.concat(F.lit("/evidence/"), F.when(pos % 69 == 8, "../").otherwise(""), pos, F.lit(".png")).alias("image_path"),
        ),
    )


def document_issues(spark, folder):
    return document_rules.named(document_rules.graph_masks(document_graph(spark, folder))).select("doc_id", "kind", "element", "code")


def provenance_terms(spark, folder):
    """Every line as a block and as evidence of it, in which the position decides the one thing that was altered."""
    pos, kind = F.col("pos"), F.col("pos") % 20
    lines = b.lines(spark, folder).where("doc_id IS NOT NULL").select("doc_id", "pos", "line")
    page, own = F.floor(pos / 30) + 1, F.floor(pos / 10)
    sure = (pos % 4 + 1) / 4
    box = F.struct(*[(F.lit(k) + F.length("line") % 7).cast("double").alias(side) for k, side in enumerate(("left", "top", "right", "bottom"))])
    source = F.struct(page.alias("pdf_page"), box.alias("box"), sure.alias("confidence"))
    blocks = lines.select(
        "doc_id", pos.alias("block_id"), F.when(pos % 23 == 2, "heading").otherwise("text").alias("block_type"), F.col("line").alias("text"),
        page.alias("pdf_page"), box.alias("box"), own.alias("section_id"), source.alias("source"),
    )
    title = F.when(F.col("section_id") % 3 == 0, "Abstract").otherwise("2. Methods")
    sections = lines.select("doc_id", own.alias("section_id")).distinct().select("*", title.alias("title"), F.array(title).alias("section_path"))

    def altered(at, wrong, right):
        return F.when(kind == at, wrong).otherwise(right)

    stated = F.when(own % 3 == 0, "Abstract").otherwise("2. Methods")
    region = F.struct(
        altered(8, page + 1, page).alias("pdf_page"), F.when(kind != 9, box).alias("box"), F.when(kind == 10, "crop.png").alias("image_path"),
        F.when(kind != 11, source).alias("source"), altered(12, F.lit(2.0), sure).alias("confidence"),
    )
    evidence = lines.select(
        "doc_id", pos.alias("evidence_id"),
        F.when(kind == 18, F.array(-pos)).when(kind == 19, F.array(pos, pos)).otherwise(F.array(pos)).alias("block_ids"),
        F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("~"), "line")).otherwise(F.col("line")).alias("evidence_text"),
        altered(2, page + 1, page).alias("pdf_page"), altered(3, own + 1, own).alias("section_id"),
        altered(13, F.lit("Title"), stated).alias("section_title"),
        altered(14, F.array(F.lit("Title")), F.array(stated)).alias("section_path"),
        F.when(kind == 4, pos).alias("visual_id"), F.when(kind == 5, "Figure").alias("label"), F.when(kind == 6, "Caption").alias("caption"),
        altered(7, F.array(region, region), F.array(region)).alias("regions"), altered(15, F.lit(2.0), sure).alias("confidence"),
        altered(16, own % 3 != 0, own % 3 == 0).alias("abstract_only"),
    )
    terms = provenance.text_terms(evidence, blocks, sections)
    return terms.select("doc_id", "evidence_id", "known", F.array_join(provenance.broken_terms(F.col("mask")), ",").alias("terms"))


PLANS = {
    "document_rules": (
        document_issues,
        f"""WITH RECURSIVE {b.LINES_SQL},
l AS (SELECT doc_id, pos, length(line) AS n, pos // 30 + 1 AS page, pos // 10 AS own FROM lines WHERE doc_id IS NOT NULL),
docs AS (SELECT doc_id, max(page) AS last FROM l GROUP BY 1),
secs AS (SELECT doc_id, own AS s, min(page) AS a, max(page) AS z FROM l GROUP BY 1, 2),
parents AS (SELECT x.doc_id, x.s, CASE WHEN x.s % 7 = 3 THEN x.s WHEN x.s % 5 = 1 THEN NULL WHEN x.s > 0 THEN (x.s - 1) // 3 END AS parent FROM secs x),
walk AS (SELECT doc_id, s, s AS cur FROM parents UNION ALL
  SELECT w.doc_id, w.s, p.parent FROM walk w JOIN parents p ON p.doc_id = w.doc_id AND p.s = w.cur WHERE p.parent IS NOT NULL AND p.parent <> p.s),
v AS (SELECT * FROM l WHERE pos % 23 = 8),
issues AS (
  SELECT doc_id, 'document' AS kind, '' AS element, 'pages_do_not_cover_document' AS code FROM docs WHERE doc_id % 10 = 4
  UNION ALL SELECT DISTINCT doc_id, 'page', page::VARCHAR, 'page_lists_unknown_block' FROM l WHERE pos % 41 = 5
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, 'block_id_not_unique' FROM l WHERE pos % 53 = 9
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, 'block_outside_page' FROM l WHERE 11 + n % 700 > 612
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, 'block_not_once_on_its_page' FROM l WHERE pos % 31 = 4
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, 'block_source_mismatch' FROM l WHERE pos % 37 = 6
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, 'block_parser_mismatch' FROM l WHERE doc_id % 10 = 3
  UNION ALL SELECT doc_id, 'block', pos::VARCHAR, unnest(['dangling_section_reference', 'membership_not_in_section']) FROM l WHERE pos % 29 = 7
  UNION ALL SELECT DISTINCT doc_id, 'section', own::VARCHAR, 'membership_not_in_block' FROM l WHERE pos % 29 = 7
  UNION ALL SELECT doc_id, 'section', s::VARCHAR, 'dangling_parent_reference' FROM secs WHERE s % 5 = 1 AND s % 7 <> 3
  UNION ALL SELECT DISTINCT doc_id, 'section', s::VARCHAR, 'section_parent_cycle' FROM walk WHERE cur % 7 = 3
  UNION ALL SELECT doc_id, 'section', s::VARCHAR, 'section_range_mismatch' FROM secs WHERE s % 11 = 2
  UNION ALL SELECT doc_id, 'section', s::VARCHAR, 'section_beyond_document' FROM secs JOIN docs USING (doc_id)
    WHERE s % 11 = 2 AND z + 1 > last + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END
  UNION ALL SELECT doc_id, 'section', s::VARCHAR, 'section_source_unresolved' FROM secs WHERE s % 13 = 4
  UNION ALL SELECT doc_id, 'section', s::VARCHAR, 'section_parser_mismatch' FROM secs WHERE doc_id % 10 = 3
  UNION ALL SELECT doc_id, 'visual', pos::VARCHAR, 'visual_section_unknown' FROM v WHERE pos % 5 = 2
  UNION ALL SELECT doc_id, 'visual', pos::VARCHAR, 'caption_without_block' FROM v WHERE pos % 46 = 8
  UNION ALL SELECT v.doc_id, 'visual', v.pos::VARCHAR, CASE WHEN c.pos IS NULL THEN 'caption_block_unknown' ELSE 'caption_block_of_other_type' END
    FROM v LEFT JOIN l c ON c.doc_id = v.doc_id AND c.pos = v.pos + 1 WHERE v.pos % 46 <> 8 AND (c.pos IS NULL OR c.n % 3 = 0)
  UNION ALL SELECT doc_id, 'region', pos || '#0', 'region_outside_page' FROM v WHERE pos % 3 = 1
  UNION ALL SELECT doc_id, 'region', pos || '#0', 'region_source_mismatch' FROM v WHERE pos % 7 = 1
  UNION ALL SELECT doc_id, 'region', pos || '#0', 'region_parser_mismatch' FROM v WHERE doc_id % 10 = 3
  UNION ALL SELECT doc_id, 'region', pos || '#0', 'image_outside_evidence_root' FROM v WHERE pos % 69 = 8)
SELECT * FROM issues""",
    ),
    "provenance_terms": (
        provenance_terms,
        f"""WITH {b.LINES_SQL}, l AS (SELECT doc_id, pos, line, pos % 20 AS kind FROM lines WHERE doc_id IS NOT NULL)
SELECT doc_id, pos AS evidence_id, kind < 18 AS known, CASE WHEN kind >= 18 THEN '' ELSE concat_ws(',',
   CASE WHEN pos % 23 = 2 THEN 'block_type' END, CASE WHEN kind = 0 OR line = '' AND kind <> 1 THEN 'evidence_text' END,
   CASE kind WHEN 1 THEN CASE WHEN NOT starts_with(line, '~' || line) THEN 'text_start' END
     WHEN 2 THEN 'pdf_page' WHEN 3 THEN 'section_id' WHEN 4 THEN 'visual_id' WHEN 5 THEN 'label' WHEN 6 THEN 'caption' WHEN 7 THEN 'one_region'
     WHEN 8 THEN 'region_page' WHEN 9 THEN 'region_box' WHEN 10 THEN 'region_image' WHEN 11 THEN 'region_source'
     WHEN 12 THEN 'region_confidence' WHEN 15 THEN 'confidence' WHEN 13 THEN 'section_title' WHEN 14 THEN 'section_path'
     WHEN 16 THEN 'abstract_only' END) END AS terms FROM l""",
    ),
}
