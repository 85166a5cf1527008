"""Document structure and evidence queries over the lines of the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import constraints, dedup, evidence, outline, validation
from lectern.plans import bindings as b
from lectern.session import materialize


def _placed(spark, folder):
    return outline.outline(outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder)), max_level=3)


_outlined = _placed


def _blocks(placed):
    return placed.where("mapped").withColumn(
        "block_type", outline.block_type(F.col("label"))
    )


def _visuals(placed):
    """Visual items refer to the two items that follow them as captions."""
    return placed.where(F.col("box").isNotNull() & outline.is_visual(F.col("label"))).select(
        "doc_id", "pos", "pdf_page", "box", "section_keys",
        F.when(F.col("label") == "table", "table").otherwise("figure").alias("kind"),
        F.array(F.col("pos") + 1, F.col("pos") + 2).alias("caption_refs"),
    )


def section_fill_forward(spark, folder):
    return _outlined(spark, folder).select(
        "doc_id", "pos", "section_pos", F.md5(F.array_join("section_path", "\x1f")).alias("path_digest")
    )


def section_parents(spark, folder):
    rows = _outlined(spark, folder).where(F.col("section_pos") == F.col("pos"))
    return rows.select(
        "doc_id", "pos", F.col("level").cast("bigint").alias("level"), "parent_pos",
        F.size("section_path").cast("bigint").alias("depth"),
    )


def coordinate_flip(spark, folder):
    placed = outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder))
    return placed.groupBy("doc_id").agg(
        F.count_if(F.col("box").isNotNull()).alias("valid_count"),
        F.count_if(F.col("box").isNull()).alias("source_mapping_invalid"),
        F.sum("box.top").alias("top_sum"), F.sum("box.bottom").alias("bottom_sum"),
    )


def block_types(spark, folder):
    return b.items(spark, folder).groupBy(outline.block_type(F.col("label")).alias("block_type")).agg(
        F.count("*").alias("n")
    )


def section_spans(spark, folder):
    return outline.section_spans(_blocks(_placed(spark, folder)))


def blocks_by_page(spark, folder):
    placed = outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder))
    blocks = _blocks(placed)
    ids = dedup.stable_id(F.col("doc_id").cast("string"), F.lit("block"), F.col("pos").cast("string"))
    per_page = dedup.set_fingerprint(
        blocks.select("doc_id", "pdf_page", F.sha2(ids, 256).alias("d")), F.col("d"), ["doc_id", "pdf_page"]
    )
    return per_page.select("doc_id", "pdf_page", "rows", "fingerprint")


def two_column_pages(spark, folder):
    placed = outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder))
    return outline.two_column_pages(_blocks(placed))


def caption_references(spark, folder):
    placed = materialize(_placed(spark, folder))
    captions = outline.visual_captions(_visuals(placed), placed)
    return captions.select(
        "doc_id", "pos", "caption_blocks", F.md5("caption").alias("caption_digest"), "caption_issue", "cross_page"
    )


def text_layer_status(spark, folder):
    return outline.text_layer_status(b.document_pages(spark, folder))


def _packets(spark, folder):
    # Blocks, visuals and captions all read the placed items, so these are written once.
    placed = materialize(_placed(spark, folder))
    visuals = _visuals(placed)
    captions = outline.visual_captions(visuals, placed)
    with_caption = visuals.join(captions.select("doc_id", "pos", "caption"), ["doc_id", "pos"], "left")
    return evidence.packets(_blocks(placed), with_caption, evidence.PacketLimits())


def evidence_packets(spark, folder):
    return _packets(spark, folder).select(
        "doc_id", "place", "evidence_id", "kind", F.col("priority").cast("bigint").alias("priority"), "pdf_page",
        "label", F.length("evidence_text").cast("bigint").alias("n_chars"),
        F.md5("evidence_text").alias("text_digest"), "abstract_only",
    )


def packet_fingerprints(spark, folder):
    return evidence.packet_fingerprints(_packets(spark, folder))


def evidence_filter(spark, folder):
    placed = outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder))
    rows = _blocks(placed).withColumn("section_keys", F.array().cast("array<string>"))
    return evidence.text_candidates(rows, evidence.UNCUT).groupBy("doc_id").agg(
        F.count("*").alias("candidate_count"), F.sum(F.length("evidence_text")).alias("chars")
    )


def graph_issues(spark, folder):
    """Graph rules on outlines of which some memberships, parents and boxes were broken on purpose."""
    outlined = materialize(_outlined(spark, folder))
    placed = outlined.select(
        "doc_id", "pos", "pdf_page", "section_pos",
        F.col("raw_left").alias("left"), F.col("raw_right").alias("right"),
        F.least("raw_top", "raw_bottom").alias("top"), F.greatest("raw_top", "raw_bottom").alias("bottom"),
    )
    wrong = F.when(F.col("pos") % 29 == 7, F.col("section_pos") + 1000000).otherwise(F.col("section_pos"))
    blocks = placed.select(
        "doc_id", F.col("pos").alias("block_id"), "pdf_page", wrong.alias("section_id"), "left", "right", "top", "bottom"
    )
    members = placed.where("section_pos IS NOT NULL").select(
        "doc_id", F.col("section_pos").alias("section_id"), F.col("pos").alias("block_id")
    )
    spans = outline.section_spans(placed).select(
        "doc_id", F.col("section_pos").alias("section_id"), "start_pdf_page", "end_pdf_page"
    )
    parents = outlined.where("section_pos = pos").select(
        "doc_id", F.col("pos").alias("section_id"),
        F.when(F.col("pos") % 5 == 1, F.col("parent_pos") + 1000000).otherwise(F.col("parent_pos")).alias("parent_id"),
    )
    sections = parents.join(spans, ["doc_id", "section_id"])
    issues = constraints.graph_issues(b.document_pages(spark, folder), blocks, sections, members)
    return issues.groupBy(F.col("paper_id").alias("doc_id"), "code").agg(F.count("*").alias("n"))


def prompt_payloads(spark, folder):
    payloads = evidence.prompt_payloads(_packets(spark, folder))
    return payloads.select(
        "doc_id", "candidate_count", F.json_array_length("payload").cast("bigint").alias("listed"),
        F.get_json_object("payload", "$[0].evidence_id").alias("first_evidence"),
    )


def evidence_identity(spark, folder):
    """Evidence ids of which some were altered, checked against their source."""
    placed = outline.place_boxes(b.items(spark, folder), b.document_pages(spark, folder))
    blocks = _blocks(placed).where(F.col("block_type").isin(*outline.TEXT_BLOCKS))
    expected = evidence.evidence_id(F.col("doc_id"), F.lit("text"), F.col("pos"), F.col("pdf_page"), F.col("box"))
    stated = blocks.withColumn("evidence_id", F.when(F.col("pos") % 7 == 3, "ev-stale").otherwise(expected))
    issues = validation.evidence_id_issues(stated, expected)
    return issues.groupBy(F.col("paper_id").alias("doc_id"), "code").agg(F.count("*").alias("n"))


def packet_identity(spark, folder):
    computed = materialize(evidence.packet_fingerprints(_packets(spark, folder)))
    stated = computed.withColumn(
        "packet_fingerprint", F.when(F.col("doc_id") % 9 == 4, "stale").otherwise(F.col("packet_fingerprint"))
    )
    return validation.fingerprint_issues(stated, computed).select(F.col("paper_id").alias("doc_id"), "code")


def section_hierarchy(spark, folder):
    """Section parents of which every fifth was cut."""
    outlined = _outlined(spark, folder).where("section_pos = pos")
    broken = F.when(F.col("pos") % 5 == 1, F.col("parent_pos") + 1000000).otherwise(F.col("parent_pos"))
    sections = outlined.select("doc_id", F.col("pos").alias("section_id"), broken.alias("parent_id"), F.col("text").alias("title"))
    issues = validation.section_hierarchy_issues(sections)
    return issues.groupBy(F.col("paper_id").cast("bigint").alias("doc_id"), "code").agg(F.count("*").alias("n"))


def visual_provenance(spark, folder):
    """Visual evidence of which some lost its source, a region or its section."""
    placed = materialize(_placed(spark, folder))
    visuals = placed.where(F.col("box").isNotNull() & outline.is_visual(F.col("label"))).select(
        "doc_id", F.col("pos").alias("visual_id"), F.col("label").alias("kind"), F.lit(None).cast("string").alias("label"),
        F.md5("text").alias("caption"), "section_pos", F.lit(0.9).alias("confidence"),
        F.array(F.struct("pdf_page", "box"), F.struct((F.col("pdf_page") + 1).alias("pdf_page"), "box")).alias("regions"),
    )
    pos = F.col("visual_id")
    stated = visuals.select(
        "doc_id", F.when(pos % 10 == 1, pos + 1000000).otherwise(pos).alias("visual_id"), "kind", "label", "caption",
        F.when(pos % 10 == 3, F.lit(-1).cast("bigint")).otherwise(F.col("section_pos")).alias("section_pos"), "confidence",
        F.when(pos % 10 == 7, F.slice("regions", 1, 1)).when(pos % 10 == 8, F.reverse("regions")).otherwise(F.col("regions")).alias("regions"),
    )
    issues = validation.visual_provenance_issues(stated, visuals)
    return issues.groupBy(F.col("paper_id").alias("doc_id"), "code").agg(F.count("*").alias("n"))


_OUTLINE_SQL = (
    b.ITEMS_SQL
    + """,
ancestors AS (
  SELECT i.doc_id, i.pos, h.pos AS hpos, h.level AS hlevel, h.text AS title FROM items i JOIN heads h
    ON h.doc_id = i.doc_id AND h.pos <= i.pos
  WHERE NOT EXISTS (SELECT 1 FROM heads z WHERE z.doc_id = i.doc_id AND z.pos > h.pos AND z.pos <= i.pos AND z.level <= h.level)),
stacks AS (SELECT doc_id, pos, max(hpos) AS section_pos, list(title ORDER BY hpos) AS path, list(hpos ORDER BY hpos) AS hp
  FROM ancestors GROUP BY doc_id, pos),
outlined AS (SELECT p.*, s.section_pos, coalesce(s.path, []) AS path, CASE WHEN len(s.hp) > 1 THEN s.hp[-2] END AS parent_pos
  FROM placed p LEFT JOIN stacks s USING (doc_id, pos)),
blocks AS (SELECT * FROM outlined WHERE ok AND label NOT IN ('table', 'picture')),
visuals AS (SELECT * FROM outlined WHERE ok AND label IN ('table', 'picture'))"""
)

_CAPTION_SQL = (
    _OUTLINE_SQL
    + """,
refs AS (SELECT v.doc_id, v.pos, v.pdf_page, k AS nth, i.text, i.pdf_page AS page, i.pos IS NOT NULL AS known, bk.pos IS NOT NULL AS mapped
  FROM visuals v CROSS JOIN (VALUES (1), (2)) t(k) LEFT JOIN items i ON i.doc_id = v.doc_id AND i.pos = v.pos + k
  LEFT JOIN blocks bk ON bk.doc_id = v.doc_id AND bk.pos = v.pos + k),
caps AS (SELECT doc_id, pos, count(*) FILTER (WHERE mapped) AS caption_blocks,
   coalesce(string_agg(trim(text), ' ' ORDER BY nth) FILTER (WHERE trim(text) <> ''), '') AS raw,
   count(DISTINCT page) > 1 OR coalesce(bool_or(page <> pdf_page), false) AS cross_page FROM refs GROUP BY doc_id, pos),
captions AS (SELECT *, CASE WHEN raw <> '' AND caption_blocks > 0 THEN raw END AS caption,
   CASE WHEN raw <> '' AND caption_blocks = 0 THEN 'caption_source_not_mapped' WHEN raw = '' THEN 'caption_not_found' END AS caption_issue FROM caps)"""
)

_NORM = r"trim(regexp_replace(lower(regexp_replace(x, '^\s*(?:(?:[A-Za-z]\.\d+(?:\.\d+)*|\d+(?:\.\d+)*)(?:[.):])?|[A-Za-z][.):])\s+', '')), '[^a-z]+', ' ', 'g'))"
_EV = """'ev-' || substr(sha256(doc_id || chr(31) || kind || chr(31) || pos || chr(31) || pdf_page || chr(31) || CAST(bl AS BIGINT) || chr(31)
   || CAST(bt AS BIGINT) || chr(31) || CAST(br AS BIGINT) || chr(31) || CAST(bb AS BIGINT)), 1, 24)"""
_PACKET_SQL = (
    _CAPTION_SQL
    + rf""",
cands AS (
  SELECT doc_id, pos, pdf_page, 'text' AS kind, 0 AS kind_order, pos AS reading_order, substr(text, 1, 2000) AS etext, path, bl, bt, br, bb
  FROM blocks WHERE label IN ('text', 'list_item', 'formula') AND trim(substr(text, 1, 2000)) <> ''
  UNION ALL
  SELECT v.doc_id, v.pos, v.pdf_page, CASE WHEN label = 'table' THEN 'table' ELSE 'figure' END, 1, 0, c.caption, path, bl, bt, br, bb
  FROM visuals v JOIN captions c USING (doc_id, pos)),
ided AS (SELECT *, {_EV} AS evidence_id, list_transform(path, lambda x: {_NORM}) AS titles FROM cands),
pri AS (SELECT *, array_to_string(titles, '|') AS joined,
   len(titles) > 0 AND len(list_filter(titles, lambda x: x NOT IN ('abstract', 'summary'))) = 0 AS abstract_only FROM ided),
prio AS (SELECT *, CASE WHEN regexp_matches(joined, 'introduction|motivation|observation|analysis') THEN 0
  WHEN regexp_matches(joined, 'method|approach|framework|algorithm') THEN 1 WHEN regexp_matches(joined, 'experiment|result|evaluation') THEN 2
  WHEN regexp_matches(joined, 'ablation') THEN 3 WHEN regexp_matches(joined, 'appendix|supplement') THEN 4 WHEN abstract_only THEN 6 ELSE 5 END AS priority FROM pri),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind_order ORDER BY priority, pdf_page, kind_order, reading_order, evidence_id) AS rk,
  least(3, count(*) FILTER (WHERE kind_order = 1) OVER (PARTITION BY doc_id)) AS nv FROM prio),
chosen AS (SELECT * FROM ranked WHERE (kind_order = 1 AND rk <= 3) OR (kind_order = 0 AND rk <= 48 - nv)),
budget AS (SELECT *, greatest(24000 - coalesce(sum(length(etext)) OVER (PARTITION BY doc_id ORDER BY priority, pdf_page, kind_order, reading_order, evidence_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS remaining FROM chosen),
packet AS (SELECT *, CASE WHEN remaining > 0 THEN substr(etext, 1, CAST(remaining AS BIGINT)) END AS evidence_text,
   row_number() OVER (PARTITION BY doc_id ORDER BY priority, pdf_page, kind_order, reading_order, evidence_id) AS place
   FROM budget WHERE kind_order = 1 OR remaining > 0)"""
)

_LANES = ", ".join(f"CAST(sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) AS VARCHAR)" for i in range(8))

PLANS = {
    "section_fill_forward": (
        section_fill_forward,
        f"WITH {_OUTLINE_SQL} SELECT doc_id, pos, section_pos, md5(coalesce(array_to_string(path, chr(31)), '')) AS path_digest FROM outlined",
    ),
    "section_parents": (
        section_parents,
        f"WITH {_OUTLINE_SQL} SELECT doc_id, pos, CAST(level AS BIGINT) AS level, parent_pos, CAST(len(path) AS BIGINT) AS depth FROM outlined WHERE section_pos = pos",
    ),
    "coordinate_flip": (
        coordinate_flip,
        f"""WITH {b.ITEMS_SQL} SELECT doc_id, count(*) FILTER (WHERE ok) AS valid_count, count(*) FILTER (WHERE NOT ok) AS source_mapping_invalid,
  sum(bt) FILTER (WHERE ok) AS top_sum, sum(bb) FILTER (WHERE ok) AS bottom_sum FROM placed GROUP BY doc_id""",
    ),
    "block_types": (
        block_types,
        f"""WITH {b.ITEMS_SQL} SELECT CASE label WHEN 'section_header' THEN 'heading' WHEN 'caption' THEN 'caption' WHEN 'formula' THEN 'formula'
  WHEN 'list_item' THEN 'list_item' WHEN 'text' THEN 'text' ELSE 'other' END AS block_type, count(*) AS n FROM items GROUP BY 1""",
    ),
    "section_spans": (
        section_spans,
        f"""WITH {_OUTLINE_SQL} SELECT doc_id, section_pos, min(pdf_page) AS start_pdf_page, max(pdf_page) AS end_pdf_page, count(*) AS block_count
FROM blocks WHERE section_pos IS NOT NULL GROUP BY 1, 2""",
    ),
    "blocks_by_page": (
        blocks_by_page,
        f"""WITH {b.ITEMS_SQL}, d AS (SELECT doc_id, pdf_page, sha256(substr(sha256(doc_id || chr(31) || 'block' || chr(31) || pos), 1, 24)) AS d
  FROM placed WHERE ok AND label NOT IN ('table', 'picture')),
s AS (SELECT doc_id, pdf_page, count(*) AS n, [{_LANES}] AS lanes FROM d GROUP BY 1, 2)
SELECT doc_id, pdf_page, n AS rows, sha256(n || ':' || array_to_string(lanes, ':')) AS fingerprint FROM s""",
    ),
    "two_column_pages": (
        two_column_pages,
        f"""WITH {b.ITEMS_SQL}, x AS (SELECT * FROM placed WHERE ok AND label NOT IN ('table', 'picture') AND br - bl < width * 0.6::DOUBLE)
SELECT DISTINCT l.doc_id, l.pdf_page FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.pdf_page = r.pdf_page
 AND least(l.bb, r.bb) > greatest(l.bt, r.bt) AND r.bl - l.br > l.width * 0.05::DOUBLE""",
    ),
    "caption_references": (
        caption_references,
        f"WITH {_CAPTION_SQL} SELECT doc_id, pos, caption_blocks, md5(caption) AS caption_digest, caption_issue, cross_page FROM captions",
    ),
    "text_layer_status": (
        text_layer_status,
        f"""WITH {b.ITEMS_SQL}, p AS (SELECT doc_id, pdf_page, sum(CASE WHEN label = 'section_header' THEN 0 ELSE n END) AS chars,
  count(*) FILTER (WHERE label IN ('table', 'picture')) AS images FROM items GROUP BY 1, 2)
SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE chars = 0) AS pages_without_text,
  CASE WHEN bool_or(chars > 0) THEN 'ready' WHEN bool_or(images > 0) THEN 'scanned' ELSE 'no_text' END AS status FROM p GROUP BY 1""",
    ),
    "evidence_filter": (
        evidence_filter,
        f"""WITH {b.ITEMS_SQL} SELECT doc_id, count(*) AS candidate_count, CAST(sum(length(text)) AS BIGINT) AS chars FROM placed
WHERE ok AND label IN ('text', 'list_item', 'formula') AND trim(text) <> '' GROUP BY 1""",
    ),
    "evidence_packets": (
        evidence_packets,
        rf"""WITH {_PACKET_SQL} SELECT doc_id, place, evidence_id, kind, CAST(priority AS BIGINT) AS priority, pdf_page,
  CASE WHEN kind_order = 1 THEN CASE WHEN regexp_extract(etext, '(?i)^\s*(?:fig(?:ure)?\.?|table)\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)', 1) <> ''
    THEN CASE kind WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || regexp_extract(etext, '(?i)^\s*(?:fig(?:ure)?\.?|table)\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)', 1) END END AS label,
  length(evidence_text) AS n_chars, md5(evidence_text) AS text_digest, abstract_only FROM packet""",
    ),
    "packet_fingerprints": (
        packet_fingerprints,
        f"""WITH {_PACKET_SQL} SELECT doc_id, count(*) AS candidate_count, sha256(string_agg(sha256(evidence_id || chr(31) || kind || chr(31) || pdf_page || chr(31)
  || coalesce(evidence_text, '')), '|' ORDER BY place)) AS packet_fingerprint FROM packet GROUP BY doc_id""",
    ),
    "graph_issues": (
        graph_issues,
        f"""WITH {_OUTLINE_SQL},
bx AS (SELECT *, CASE WHEN pos % 29 = 7 THEN section_pos + 1000000 ELSE section_pos END AS sid,
  CASE WHEN pos % 3 = 0 THEN 792 - ((pos % 30) * 25 + 4 + 8 + n % 40) ELSE (pos % 30) * 25 + 4 END AS t0,
  CASE WHEN pos % 3 = 0 THEN 792 - ((pos % 30) * 25 + 4) ELSE (pos % 30) * 25 + 4 + 8 + n % 40 END AS b0 FROM outlined),
spans AS (SELECT doc_id, section_pos, min(pdf_page) AS a, max(pdf_page) AS z FROM outlined WHERE section_pos IS NOT NULL GROUP BY 1, 2),
moved AS (SELECT doc_id, sid, min(pdf_page) AS a, max(pdf_page) AS z FROM bx WHERE sid IS NOT NULL GROUP BY 1, 2),
issues AS (
  SELECT doc_id, 'block_outside_page' AS code FROM bx WHERE NOT (bl >= 0 AND t0 >= 0 AND br <= width AND b0 <= height)
  UNION ALL SELECT doc_id, 'dangling_section_reference' FROM bx WHERE sid >= 1000000
  UNION ALL SELECT doc_id, 'membership_not_in_block' FROM bx WHERE section_pos IS NOT NULL AND sid <> section_pos
  UNION ALL SELECT doc_id, 'membership_not_in_section' FROM bx WHERE section_pos IS NOT NULL AND sid <> section_pos
  UNION ALL SELECT o.doc_id, 'dangling_parent_reference' FROM outlined o WHERE o.section_pos = o.pos AND pos % 5 = 1 AND parent_pos IS NOT NULL
  UNION ALL SELECT s.doc_id, 'section_range_mismatch' FROM spans s JOIN moved m ON m.doc_id = s.doc_id AND m.sid = s.section_pos WHERE s.a <> m.a OR s.z <> m.z)
SELECT doc_id, code, count(*) AS n FROM issues GROUP BY 1, 2""",
    ),
    "prompt_payloads": (
        prompt_payloads,
        f"""WITH {_PACKET_SQL} SELECT doc_id, count(*) AS candidate_count, count(*) AS listed, arg_min(evidence_id, place) AS first_evidence FROM packet GROUP BY 1""",
    ),
    "evidence_identity": (
        evidence_identity,
        f"""WITH {b.ITEMS_SQL} SELECT doc_id, 'evidence_id_mismatch' AS code, count(*) AS n FROM placed
WHERE ok AND label IN ('text', 'list_item', 'formula') AND pos % 7 = 3 GROUP BY 1""",
    ),
    "packet_identity": (
        packet_identity,
        f"WITH {_PACKET_SQL} SELECT DISTINCT doc_id, 'packet_fingerprint_mismatch' AS code FROM packet WHERE doc_id % 9 = 4",
    ),
    "section_hierarchy": (
        section_hierarchy,
        f"""WITH {_OUTLINE_SQL} SELECT doc_id, 'section_hierarchy_invalid' AS code, count(*) AS n FROM stacks s JOIN heads h USING (doc_id, pos)
WHERE len(list_filter(hp[2:], lambda x: x % 5 = 1)) > 0 GROUP BY 1""",
    ),
    "visual_provenance": (
        visual_provenance,
        f"""WITH {_OUTLINE_SQL}, i AS (SELECT doc_id, CASE WHEN pos % 10 = 1 THEN 'evidence_source_missing'
  WHEN pos % 10 IN (3, 7, 8) THEN 'visual_provenance_mismatch' END AS code FROM visuals)
SELECT doc_id, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1, 2""",
    ),
}
