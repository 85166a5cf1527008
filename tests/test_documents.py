import random

import pytest

from lectern.operators import constraints, evidence, hierarchy, outline


def test_cycles_and_dangling_parents_are_reported(spark):
    nodes = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"),
             ("z", "x", "Z"), ("m", "gone", "M"), ("n", "m", "N"), ("s", "s", "S"), ("e", "", "E")]
    df = spark.createDataFrame(nodes, "key string, parent string, name string")
    got = {r.key: (r.path, r.status) for r in hierarchy.ancestor_paths(df, "key", "parent", "name").collect()}
    assert got == {
        "a": ("A", "ok"), "b": ("A/B", "ok"), "c": ("A/B/C", "ok"), "e": ("E", "ok"),
        "x": (None, "collection_cycle"), "y": (None, "collection_cycle"), "z": (None, "collection_cycle"),
        "s": (None, "collection_cycle"), "m": (None, "missing_collection"), "n": (None, "missing_collection"),
    }


def test_long_chain(spark):
    nodes = [(k, k - 1 if k else None, str(k)) for k in range(70)]
    df = spark.createDataFrame(nodes, "key long, parent long, name string")
    rows = hierarchy.ancestor_paths(df, "key", "parent", "name").collect()
    assert len(rows) == 70
    for r in rows:
        assert r.path == "/".join(str(k) for k in range(r.key + 1)) and r.depth == r.key + 1


def test_item_paths_isolate_broken_keys(spark):
    paths = spark.createDataFrame([("a", "A", "ok"), ("b", None, "collection_cycle")], "key string, path string, status string")
    items = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, []), (3, ["b"])], "item long, ks array<string>")
    got = {r.item: r for r in hierarchy.item_paths(items, "item", "ks", paths, "key").collect()}
    assert (got[1].paths, got[1].broken_keys, got[1].listed_keys) == (["A"], 2, 3)
    assert (got[2].paths, got[2].listed_keys) == ([], 0)
    assert (got[3].paths, got[3].broken_keys) == ([], 1)


ITEM = "doc_id long, pos long, text string, label string, level int, pdf_page long"


def _stack(items):
    """The heading stack as a loop, per document."""
    result, stacks = {}, {}
    for doc, pos, text, label, level, _ in sorted(items, key=lambda r: (r[0], r[1])):
        stack = stacks.setdefault(doc, [])
        if label == "section_header" and text.strip():
            while stack and stack[-1][1] >= level:
                stack.pop()
            stack.append((pos, level, text))
        result[(doc, pos)] = (
            stack[-1][0] if stack else None,
            stack[-2][0] if len(stack) > 1 else None,
            [s[2] for s in stack],
        )
    return result


def test_outline_equals_the_stack(spark, monkeypatch):
    rng = random.Random(9)
    items = []
    for doc in range(25):
        for pos in range(rng.randrange(1, 60)):
            heading = rng.random() < 0.35
            text = "" if heading and rng.random() < 0.1 else f"t{pos}"
            items.append((doc, pos, text, "section_header" if heading else "text", rng.randrange(1, 5), 1))
    expected = _stack(items)
    df = spark.createDataFrame(items, ITEM).repartition(4)
    for slot in (4096, 7):
        monkeypatch.setattr(outline, "SLOT_ITEMS", slot)
        for r in outline.outline(df, max_level=4).collect():
            assert (r.section_pos, r.parent_pos, r.section_path) == expected[(r.doc_id, r.pos)]


def test_level_beyond_the_maximum_fails(spark):
    df = spark.createDataFrame([(1, 0, "t", "title", 9, 1)], ITEM)
    with pytest.raises(Exception, match="max_level"):
        outline.outline(df, max_level=3).collect()


BOX = "doc_id long, pdf_page long, width double, box struct<left: double, top: double, right: double, bottom: double>"


def _two_columns(boxes, width):
    for a in boxes:
        for b in boxes:
            overlap = min(a[3], b[3]) - max(a[1], b[1])
            if (overlap > 0 and b[0] - a[2] > width * 0.05
                    and a[2] - a[0] < width * 0.6 and b[2] - b[0] < width * 0.6):
                return True
    return False


def test_two_columns_equal_the_pairwise_check(spark):
    rng = random.Random(12)
    rows, expected = [], set()
    for page in range(120):
        boxes = []
        for _ in range(rng.randrange(1, 7)):
            left, top = rng.randrange(0, 500), rng.randrange(0, 700)
            if page % 2:  # boxes as parsers give them, with fractions of a unit
                left, top = left + rng.random(), top + rng.random()
            boxes.append((float(left), float(top), float(left + rng.randrange(20, 400)), top + rng.choice([0.3, 0.6, 1.0, 7.5, 30.0, 60.0])))
        rows += [(page // 4, page % 4 + 1, 600.0, box) for box in boxes]
        if _two_columns(boxes, 600.0):
            expected.add((page // 4, page % 4 + 1))
    df = spark.createDataFrame(rows, BOX)
    got = {(r.doc_id, r.pdf_page) for r in outline.two_column_pages(df).collect()}
    assert got == expected and 0 < len(expected) < 120


def test_narrow_overlaps_make_two_columns(spark):
    rows = [
        (1, 1, 600.0, (50.0, 100.2, 250.0, 100.8)), (1, 1, 600.0, (300.0, 100.2, 500.0, 100.8)),
        (2, 1, 600.0, (50.0, 100.0, 250.0, 110.95)), (2, 1, 600.0, (300.0, 110.05, 500.0, 120.0)),
        (3, 1, 600.0, (50.0, 100.0, 250.0, 110.0)), (3, 1, 600.0, (300.0, 110.0, 500.0, 120.0)),
        (4, 1, 9e6, (50.0, 5e6, 250.0, 5e6 + 1)), (4, 1, 9e6, (1e6, 5e6, 1.1e6, 5e6 + 1)),
    ]
    got = outline.two_column_pages(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4]


def test_headings_off_the_page_open_nothing_and_levels_have_no_maximum(spark):
    items = spark.createDataFrame(
        [(1, 0, "Real", "section_header", 1, 10.0), (1, 1, "Ghost", "section_header", 1, 990.0), (1, 2, "Text", "text", None, 30.0),
         (1, 3, "Deep", "section_header", 12, 40.0), (1, 4, "More", "text", None, 50.0)],
        "doc_id long, pos long, text string, label string, level int, raw_top double",
    ).selectExpr("*", "bigint(1) AS pdf_page", "raw_top + 5 AS raw_bottom", "double(5) AS raw_left", "double(90) AS raw_right", "'top_left' AS origin")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0)], "doc_id long, pdf_page long, width double, height double")
    rows = outline.outline(outline.place_boxes(items, pages)).orderBy("pos").collect()
    assert [r.section_path for r in rows] == [["Real"], ["Real"], ["Real"], ["Real", "Deep"], ["Real", "Deep"]]


def test_boxes_are_flipped_and_checked(spark):
    items = spark.createDataFrame(
        [(1, 0, "text", 1, 10.0, 90.0, 20.0, 80.0, "bottom_left"), (1, 1, "text", 1, 10.0, 5.0, 20.0, 15.0, "top_left"),
         (1, 2, "text", 1, 10.0, 5.0, 120.0, 15.0, "top_left"), (1, 3, "text", 1, 10.0, 5.0, 10.0, 15.0, "top_left"),
         (1, 4, "text", 9, 10.0, 5.0, 20.0, 15.0, "top_left"), (1, 5, "table", 1, 10.0, 5.0, 20.0, 15.0, "top_left")],
        "doc_id long, pos long, label string, pdf_page long, raw_left double, raw_top double, raw_right double, raw_bottom double, origin string",
    )
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0)], "doc_id long, pdf_page long, width double, height double")
    got = {r.pos: r for r in outline.place_boxes(items, pages).collect()}
    assert (got[0].box.top, got[0].box.bottom) == (10.0, 20.0)
    assert got[1].box.top == 5.0 and got[1].mapped
    assert all(got[p].box is None and not got[p].mapped for p in (2, 3, 4))
    assert got[5].box is not None and not got[5].mapped


def test_caption_issues(spark):
    items = spark.createDataFrame(
        [(1, 1, " Figure 2: a ", 1, True), (1, 2, "more", 2, True), (1, 3, "lost", 1, False), (1, 4, " ", 1, True)],
        "doc_id long, pos long, text string, pdf_page long, mapped boolean",
    )
    visuals = spark.createDataFrame(
        [(1, 10, 1, [1, 2]), (1, 11, 1, [3]), (1, 12, 1, [4, 99]), (1, 13, 1, [])],
        "doc_id long, pos long, pdf_page long, caption_refs array<long>",
    )
    got = {r.pos: r for r in outline.visual_captions(visuals, items).collect()}
    assert (got[10].caption, got[10].cross_page, got[10].caption_issue) == ("Figure 2: a more", True, None)
    assert (got[11].caption, got[11].caption_issue) == (None, "caption_source_not_mapped")
    assert got[12].caption_issue == got[13].caption_issue == "caption_not_found"


CANDIDATE = ("doc_id long, evidence_id string, kind string, priority int, pdf_page long, kind_order int, "
             "reading_order long, evidence_text string, label string, abstract_only boolean, stable_id string")


def _packet(rows, limits):
    """Selection and budget as a loop over one document."""
    order = lambda r: (r[3], r[4], r[5], r[6], r[10])
    visuals = sorted((r for r in rows if r[5] == 1), key=order)[: min(limits.max_visuals, limits.max_candidates)]
    texts = sorted((r for r in rows if r[5] == 0), key=order)[: max(limits.max_candidates - len(visuals), 0)]
    left, result = limits.max_chars, []
    for r in sorted(visuals + texts, key=order):
        text = r[7]
        if text is not None:
            if left <= 0:
                if r[2] == "text":
                    continue
                text = None
            else:
                text = text[:left]
                left -= len(text)
        result.append((r[1], text))
    return result


def test_packets_equal_the_loop(spark):
    rng = random.Random(21)
    limits = evidence.PacketLimits(max_candidates=10, max_chars=300, max_visuals=2)
    rows = []
    for doc in range(40):
        for k in range(rng.randrange(1, 25)):
            visual = rng.random() < 0.25
            text = None if visual and rng.random() < 0.4 else "x" * rng.randrange(1, 80)
            rows.append((doc, f"e{k}", "figure" if visual else "text", rng.randrange(7), rng.randrange(1, 4),
                         int(visual), 0 if visual else k, text, None, False, f"s{k:02d}"))
    df = spark.createDataFrame(rows, CANDIDATE).repartition(5)
    got = evidence.character_budget(evidence.reserve_visuals(df, limits), limits).orderBy("doc_id", "place").collect()
    for doc in range(40):
        expected = _packet([r for r in rows if r[0] == doc], limits)
        mine = [(r.evidence_id, r.evidence_text) for r in got if r.doc_id == doc]
        assert mine == expected


def test_quota_cuts_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([], CANDIDATE)
    plan = evidence.reserve_visuals(df, evidence.PacketLimits())._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_graph_rules(spark):
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 100.0, 100.0)], "doc_id long, pdf_page long, width double, height double")
    schema = "doc_id long, block_id long, pdf_page long, section_id long, left double, right double, top double, bottom double"
    blocks = spark.createDataFrame(
        [(1, 1, 1, 7, 0.0, 10.0, 0.0, 10.0), (1, 2, 2, 7, 0.0, 200.0, 0.0, 10.0), (1, 3, 3, None, 0.0, 1.0, 0.0, 1.0),
         (1, 4, 1, 99, 5.0, 5.0, 0.0, 1.0), (1, 1, 1, 7, 0.0, 10.0, 0.0, 10.0)], schema)
    sections = spark.createDataFrame([(1, 7, 55, 1, 1)], "doc_id long, section_id long, parent_id long, start_pdf_page long, end_pdf_page long")
    members = spark.createDataFrame([(1, 7, 1), (1, 7, 8)], "doc_id long, section_id long, block_id long")
    codes = {r.code for r in constraints.graph_issues(pages, blocks, sections, members).collect()}
    assert codes == {
        "block_outside_page", "block_without_area", "dangling_section_reference", "membership_not_in_block",
        "membership_not_in_section", "section_range_mismatch", "dangling_parent_reference", "block_id_not_unique",
    }


def test_text_layer_status(spark):
    rows = [("a", 5, 0), ("a", 0, 0), ("b", 0, 1), ("b", 0, 0), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, text_chars long, image_count long")
    got = {r.doc_id: r.status for r in outline.text_layer_status(df).collect()}
    assert got == {"a": "ready", "b": "scanned", "c": "no_text"}
