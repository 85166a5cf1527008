import copy
import re

import pytest

from lectern.operators import document_rules as rules
from lectern.operators.document_rules import Graph, RULES

BOX = "struct<left:double,top:double,right:double,bottom:double>"
SOURCE = f"struct<pdf_page:bigint,box:{BOX},parser:string,parser_version:string>"
SCHEMAS = {
    "documents": "doc_id bigint, page_count bigint, parser string, parser_version string, evidence_root string",
    "pages": "doc_id bigint, pdf_page bigint, width double, height double",
    "page_blocks": "doc_id bigint, pdf_page bigint, block_id string",
    "blocks": f"doc_id bigint, block_id string, block_type string, pdf_page bigint, box {BOX}, section_id string, source {SOURCE}",
    "sections": f"doc_id bigint, section_id string, parent_id string, start_pdf_page bigint, end_pdf_page bigint, source {SOURCE}",
    "section_blocks": "doc_id bigint, section_id string, block_id string",
    "visuals": "doc_id bigint, visual_id string, section_id string, caption string",
    "caption_blocks": "doc_id bigint, visual_id string, block_id string",
    "regions": f"doc_id bigint, visual_id string, nth int, pdf_page bigint, box {BOX}, source {SOURCE}, image_path string",
}
B, WIDE = [1.0, 1.0, 9.0, 9.0], [1.0, 1.0, 11.0, 9.0]
NAMES = {table: [part.split()[0] for part in ddl.replace(BOX, "b").replace(f"struct<pdf_page:bigint,box:b,parser:string,parser_version:string>", "s").split(", ")] for table, ddl in SCHEMAS.items()}


def _source(page, box=B):
    return [page, box, "p", "1"]


def _good(doc):
    return {
        "documents": [[doc, 2, "p", "1", "/e/root"]],
        "pages": [[doc, 1, 10.0, 10.0], [doc, 2, 10.0, 10.0]],
        "page_blocks": [[doc, 1, "a"], [doc, 2, "b"], [doc, 2, "c"]],
        "blocks": [[doc, "a", "text", 1, B, "s", _source(1)], [doc, "b", "caption", 2, B, "t", _source(2)], [doc, "c", "text", 2, B, None, _source(2)]],
        "sections": [[doc, "s", None, 1, 1, _source(1)], [doc, "t", "s", 2, 2, _source(2)]],
        "section_blocks": [[doc, "s", "a"], [doc, "t", "b"]],
        "visuals": [[doc, "v", "t", "Figure 1"], [doc, "w", None, None]],
        "caption_blocks": [[doc, "v", "b"]],
        "regions": [[doc, "v", 0, 2, B, _source(2), "/e/root/x/../v.png"], [doc, "w", 0, 1, B, _source(1), None]],
    }


def _set(table, row, column, value):
    def change(graph):
        graph[table][row][NAMES[table].index(column)] = value

    return change


def _add(table, *values):
    return lambda graph: graph[table].append([graph["documents"][0][0], *values])


# Each rule broken once, with all the codes this must give.
CASES = {
    "page_number_not_unique": (_add("pages", 2, 10.0, 10.0), {"page_number_not_unique"}),
    "pages_do_not_cover_document": (_set("documents", 0, "page_count", 3), {"pages_do_not_cover_document"}),
    "block_id_not_unique": (_add("blocks", "c", "text", 2, B, None, _source(2)), {"block_id_not_unique"}),
    "section_id_not_unique": (_add("sections", "s", None, 1, 1, _source(1)), {"section_id_not_unique"}),
    "visual_id_not_unique": (_add("visuals", "w", None, None), {"visual_id_not_unique"}),
    "page_lists_unknown_block": (_add("page_blocks", 1, "z"), {"page_lists_unknown_block"}),
    "block_outside_page": (
        lambda g: [_set("blocks", 2, "box", WIDE)(g), _set("blocks", 2, "source", _source(2, WIDE))(g)], {"block_outside_page"}),
    "block_not_once_on_its_page": (_add("page_blocks", 2, "c"), {"block_not_once_on_its_page"}),
    "block_source_mismatch": (_set("blocks", 0, "source", _source(2)), {"block_source_mismatch"}),
    "block_parser_mismatch": (_set("blocks", 0, "source", [1, B, "p", "2"]), {"block_parser_mismatch"}),
    "dangling_section_reference": (_set("blocks", 2, "section_id", "z"), {"dangling_section_reference", "membership_not_in_section"}),
    "dangling_parent_reference": (_set("sections", 1, "parent_id", "z"), {"dangling_parent_reference"}),
    "section_lists_unknown_block": (_add("section_blocks", "s", "z"), {"section_lists_unknown_block"}),
    "section_beyond_document": (_set("sections", 1, "end_pdf_page", 3), {"section_beyond_document", "section_range_mismatch"}),
    "section_range_mismatch": (_set("sections", 0, "end_pdf_page", 2), {"section_range_mismatch"}),
    "section_source_unresolved": (_set("sections", 1, "source", _source(1)), {"section_source_unresolved"}),
    "section_parser_mismatch": (_set("sections", 1, "source", [2, B, "q", "1"]), {"section_parser_mismatch"}),
    "membership_not_in_block": (_add("section_blocks", "t", "c"), {"membership_not_in_block"}),
    "membership_not_in_section": (_set("blocks", 2, "section_id", "t"), {"membership_not_in_section"}),
    "section_parent_cycle": (_set("sections", 0, "parent_id", "t"), {"section_parent_cycle"}),
    "visual_section_unknown": (_set("visuals", 1, "section_id", "z"), {"visual_section_unknown"}),
    "caption_block_unknown": (_add("caption_blocks", "w", "z"), {"caption_block_unknown"}),
    "caption_block_of_other_type": (_add("caption_blocks", "w", "c"), {"caption_block_of_other_type"}),
    "caption_without_block": (_set("visuals", 1, "caption", "Table 1"), {"caption_without_block"}),
    "region_outside_page": (
        lambda g: [_set("regions", 1, "pdf_page", 7)(g), _set("regions", 1, "source", _source(7))(g)], {"region_outside_page"}),
    "region_source_mismatch": (_set("regions", 1, "source", _source(1, WIDE)), {"region_source_mismatch"}),
    "region_parser_mismatch": (_set("regions", 1, "source", [1, B, None, "1"]), {"region_parser_mismatch"}),
    "image_outside_evidence_root": (_set("regions", 0, "image_path", "/e/root/../rootless.png"), {"image_outside_evidence_root"}),
}


def _frames(spark, graphs):
    rows = {table: [row for graph in graphs for row in graph[table]] for table in SCHEMAS}
    return Graph(**{table: spark.createDataFrame(rows[table], ddl) for table, ddl in SCHEMAS.items()})


def test_each_rule_once_and_no_other(spark):
    assert set(CASES) == set(RULES) and len(RULES) == 28
    graphs = [_good(0)]
    for doc, (change, _) in enumerate(CASES.values(), start=1):
        graph = copy.deepcopy(_good(doc))
        change(graph)
        graphs.append(graph)
    found = {}
    for row in rules.named(rules.graph_masks(_frames(spark, graphs))).collect():
        found.setdefault(row.doc_id, set()).add(row.code)
    assert found == {doc: codes for doc, (_, codes) in enumerate(CASES.values(), start=1)}


def test_empty_tables(spark):
    empty = {table: [] for table in SCHEMAS}
    assert rules.named(rules.graph_masks(_frames(spark, [empty]))).count() == 0


@pytest.mark.parametrize("path, root, inside", [
    ("/e/root", "/e/root", True), ("/e/root/", "/e//root", True), ("/e/root/a", "/e/./root/", True), ("/e/rootless", "/e/root", False),
    ("/e/root/../x", "/e/root", False), ("/../e/root/x", "/e/root", True), ("x", "/", False), ("a/b", "a", True), (None, "/e", None),
])
def test_paths_within_a_root(spark, path, root, inside):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path, root)], "p string, r string")
    assert df.select(rules.path_within(F.col("p"), F.col("r")).alias("x")).first().x is inside


def test_blocks_are_dealt_by_their_number_and_null_ids_match_nothing(spark, monkeypatch):
    graph = _good(0)
    for change in (
        _add("blocks", None, "text", 2, B, None, _source(2)), _add("blocks", "d", "text", 2, B, "t", _source(2)),
        _add("page_blocks", 2, None), _add("section_blocks", "t", None), _add("caption_blocks", "w", None),
    ):
        change(graph)
    frames = _frames(spark, [graph])
    found = []
    for rows in (rules.ROWS_PER_TASK, 2):
        monkeypatch.setattr(rules, "ROWS_PER_TASK", rows)
        masks = rules.graph_masks(frames)
        found.append({(r.kind, r.element, r.code) for r in rules.named(masks).collect()})
        count = -(-sum(len(graph[t]) for t in ("blocks", "page_blocks", "section_blocks", "caption_blocks")) // rows)
        plan = masks._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(rf"RepartitionByExpression \[doc_id#\d+L, block_id#\d+\], {count}\b", plan)
    assert found[0] == found[1] == {
        ("block", "d", "block_not_once_on_its_page"), ("block", "d", "membership_not_in_section"),
        ("page", "2", "page_lists_unknown_block"), ("section", "t", "section_lists_unknown_block"), ("visual", "w", "caption_block_unknown"),
    }
