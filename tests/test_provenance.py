import copy

from lectern.operators import provenance
from lectern.operators.provenance import TERMS

SOURCE = "struct<pdf_page:bigint,parser:string,confidence:double>"
BOX = "struct<left:double,top:double,right:double,bottom:double>"
REGION = f"struct<pdf_page:bigint,box:{BOX},image_path:string,source:{SOURCE},confidence:double>"
EVIDENCE = (
    "doc_id bigint, evidence_id string, block_ids array<string>, evidence_text string, pdf_page bigint, section_id string,"
    "section_title string, section_path array<string>, visual_id string, label string, caption string,"
    f"regions array<{REGION}>, confidence double, abstract_only boolean"
)
BLOCK = f"doc_id bigint, block_id string, block_type string, text string, pdf_page bigint, box {BOX}, section_id string, source {SOURCE}"
SECTION = "doc_id bigint, section_id string, title string, section_path array<string>"
B, S = [1.0, 2.0, 3.0, 4.0], [2, "p", 0.5]


def _evidence(name, **change):
    row = {
        "doc_id": 1, "evidence_id": name, "block_ids": ["b"], "evidence_text": "The", "pdf_page": 2, "section_id": "s",
        "section_title": "1. Abstract", "section_path": ["1. Abstract"], "visual_id": None, "label": None, "caption": None,
        "regions": [[2, B, None, S, 0.5]], "confidence": 0.5, "abstract_only": True,
    }
    return copy.deepcopy({**row, **change})


CASES = {
    "good": ({}, []),
    "of_a_heading": ({"block_ids": ["h"]}, ["block_type"]),
    "null_text": ({"evidence_text": None}, ["evidence_text"]),
    "empty_text": ({"evidence_text": ""}, ["evidence_text"]),
    "later_text": ({"evidence_text": "text"}, ["text_start"]),
    "page": ({"pdf_page": 3}, ["pdf_page"]),
    "section": ({"section_id": None}, ["section_id"]),
    "title": ({"section_title": None}, ["section_title"]),
    "path": ({"section_path": None}, ["section_path"]),
    "visual": ({"visual_id": "v"}, ["visual_id"]),
    "label": ({"label": ""}, ["label"]),
    "caption": ({"caption": "c"}, ["caption"]),
    "no_region": ({"regions": []}, ["one_region"]),
    "null_regions": ({"regions": None}, ["one_region"]),
    "two_regions": ({"regions": [[2, B, None, S, 0.5]] * 2}, ["one_region"]),
    "region_page": ({"regions": [[1, B, None, S, 0.5]]}, ["region_page"]),
    "region_box": ({"regions": [[2, None, None, S, 0.5]]}, ["region_box"]),
    "region_image": ({"regions": [[2, B, "x.png", S, 0.5]]}, ["region_image"]),
    "region_source": ({"regions": [[2, B, None, [2, "q", 0.5], 0.5]]}, ["region_source"]),
    "region_confidence": ({"regions": [[2, B, None, S, None]]}, ["region_confidence"]),
    "confidence": ({"confidence": 0.25}, ["confidence"]),
    "abstract": ({"abstract_only": False}, ["abstract_only"]),
    "two_terms": ({"confidence": None, "label": "Figure 1"}, ["label", "confidence"]),
    "without_section": ({"block_ids": ["n"], "section_id": None, "section_title": None, "section_path": [], "abstract_only": False}, []),
    "other_document": ({"doc_id": 2}, None),
    "no_block": ({"block_ids": []}, None),
    "null_blocks": ({"block_ids": None}, None),
    "two_blocks": ({"block_ids": ["b", "h"]}, None),
    "unknown_block": ({"block_ids": ["z"]}, None),
}


def _frames(spark):
    blocks = spark.createDataFrame(
        [(1, "b", "text", "The text", 2, B, "s", S), (1, "h", "heading", "The", 2, B, "s", S), (1, "n", "formula", "The", 2, B, None, S)], BLOCK
    )
    return blocks, spark.createDataFrame([(1, "s", "1. Abstract", ["1. Abstract"]), (2, "s", "Other", ["Other"])], SECTION)


def test_each_term_alone(spark):
    evidence = spark.createDataFrame([tuple(_evidence(n, **c).values()) for n, (c, _) in CASES.items()], EVIDENCE)
    terms = provenance.text_terms(evidence, *_frames(spark))
    rows = terms.withColumn("terms", provenance.broken_terms(terms["mask"])).collect()
    assert {r.evidence_id: r.terms if r.known else None for r in rows} == {n: expected for n, (_, expected) in CASES.items()}
    assert {t for _, found in CASES.values() for t in found or []} == set(TERMS) and len(TERMS) == 18
    issues = {(r.evidence_id, r.code) for r in provenance.text_issues(terms).collect()}
    assert issues == {
        (n, "evidence_source_missing" if found is None else "text_provenance_mismatch") for n, (_, found) in CASES.items() if found != []
    }


def test_empty_tables(spark):
    blocks, sections = _frames(spark)
    one = spark.createDataFrame([tuple(_evidence("a").values())], EVIDENCE)
    assert provenance.text_terms(one.where("false"), blocks, sections).count() == 0
    assert not provenance.text_terms(one, blocks.where("false"), sections.where("false")).first().known
