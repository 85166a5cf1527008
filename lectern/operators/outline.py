"""Document structure: sections from headings, boxes on pages, captions, columns.

Items carry ``doc_id, pos`` (reading order), ``text, label, pdf_page`` and, for
headings, ``level``; ``item_count``, the number of items of the document, is
optional and saves work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.fixedpoint import int_div
from lectern.functions.text import normalized_title, not_blank, strip
from lectern.operators.scan import Running, ordered_scan

# Labels as layout parsers emit them.
HEADING_LABELS = ("section_header", "title", "heading")
CAPTION_LABELS = ("caption", "figure_caption", "table_caption")
VISUAL_LABELS = ("table", "picture", "figure")
TEXT_BLOCKS = ("text", "list_item", "formula")

SLOT_ITEMS = 4096


def is_heading(label: Column) -> Column:
    return F.lower(label).isin(*HEADING_LABELS)


def is_visual(label: Column) -> Column:
    return F.lower(label).isin(*VISUAL_LABELS)


def block_type(label: Column) -> Column:
    name = F.lower(label)
    return (
        F.when(name.isin(*HEADING_LABELS), "heading")
        .when(name.isin(*CAPTION_LABELS), "caption")
        .when(name.isin("formula", "list_item"), name)
        .when(name.isin("text", "paragraph"), "text")
        .otherwise("other")
    )


def section_level(parser_level: Column) -> Column:
    return F.greatest(F.lit(1), parser_level + 1)


def outline(items: DataFrame, max_level: int | None = None) -> DataFrame:
    """Add ``section_pos``, ``parent_pos``, ``section_path`` (titles, outermost first) and
    ``section_keys`` (the same titles normalised).

    The open sections at an item are the last headings of each level that no later
    heading of the same or an outer level has closed.  So one running maximum per
    level replaces a stack, and long documents are scanned in slots.  ``max_level`` is the
    deepest level to expect; by default it is looked up among the items.
    """
    if max_level is None:
        deepest = items.where(is_heading(F.col("label"))).agg(F.max("level")).first()[0]
        max_level = max(1, deepest or 1)
    opens = is_heading(F.col("label")) & not_blank(F.col("text"))
    if "box" in items.columns:
        # A heading that lies on no page opens nothing.
        opens = opens & F.col("box").isNotNull()
    level = F.when(F.col("level").isNull() | (F.col("level") <= max_level), F.col("level")).otherwise(
        F.raise_error(F.lit("section level exceeds max_level")).cast("int")
    )
    scans = {
        f"_open{n}": Running(
            "max",
            F.when(
                opens & (level == n),
                F.struct("pos", F.col("text").alias("title"), normalized_title(F.col("text")).alias("key")),
            ),
        )
        for n in range(1, max_level + 1)
    }
    scanned = ordered_scan(
        items, ["doc_id"], [F.col("pos")], scans,
        slot=int_div(F.col("pos"), F.lit(SLOT_ITEMS)),
        spanning=F.col("item_count") > SLOT_ITEMS if "item_count" in items.columns else None,
    )
    stack = []
    for n in range(1, max_level + 1):
        here = F.col(f"_open{n}")
        outer = [F.coalesce(F.col(f"_open{m}")["pos"], F.lit(-1)) for m in range(1, n)]
        still_open = reduce(lambda a, o: a & (here["pos"] > o), outer, here.isNotNull())
        stack.append(F.when(still_open, here))
    with_stack = scanned.withColumn("_stack", F.array_compact(F.array(*stack)))
    depth = F.size("_stack")
    return with_stack.select(
        *items.columns,
        F.when(depth > 0, F.element_at("_stack", -1)["pos"]).alias("section_pos"),
        F.when(depth > 1, F.element_at("_stack", -2)["pos"]).alias("parent_pos"),
        F.transform("_stack", lambda s: s["title"]).alias("section_path"),
        F.transform("_stack", lambda s: s["key"]).alias("section_keys"),
    )


def place_boxes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes with the origin at the top left, null where a box is not inside its page.

    Comes before :func:`outline`, which takes headings without a box for none.

    ``mapped`` marks the items that become blocks.
    """
    joined = items.join(pages.select("doc_id", "pdf_page", "width", "height"), ["doc_id", "pdf_page"], "left")
    flipped = F.col("origin") == "bottom_left"
    top = F.when(flipped, F.col("height") - F.col("raw_top")).otherwise(F.col("raw_top"))
    bottom = F.when(flipped, F.col("height") - F.col("raw_bottom")).otherwise(F.col("raw_bottom"))
    sized = joined.withColumn("_top", top).withColumn("_bottom", bottom)
    finite = [~F.isnan(c) & (F.abs(c) != float("inf")) for c in (F.col("raw_left"), F.col("_top"))]
    valid = (
        finite[0] & finite[1]
        & (F.col("raw_right") > F.col("raw_left")) & (F.col("_bottom") > F.col("_top"))
        & (F.col("raw_left") >= 0) & (F.col("_top") >= 0)
        & (F.col("raw_right") <= F.col("width")) & (F.col("_bottom") <= F.col("height"))
    )
    box = F.when(
        valid,
        F.struct(
            F.col("raw_left").alias("left"), F.col("_top").alias("top"),
            F.col("raw_right").alias("right"), F.col("_bottom").alias("bottom"),
        ),
    )
    placed = sized.withColumn("box", box)
    mapped = F.col("box").isNotNull() & ~is_visual(F.col("label"))
    return placed.withColumn("mapped", mapped).drop("_top", "_bottom")


def section_spans(blocks: DataFrame) -> DataFrame:
    return blocks.where("section_pos IS NOT NULL").groupBy("doc_id", "section_pos").agg(
        F.min("pdf_page").alias("start_pdf_page"),
        F.max("pdf_page").alias("end_pdf_page"),
        F.count("*").alias("block_count"),
    )


def two_column_pages(placed: DataFrame) -> DataFrame:
    """Pages on which two narrow boxes share a vertical range with a gap between them.

    Box edges are replaced by their rank among the distinct edges of the page, which keeps
    every overlap exact.  Each vertical range is then cut into the few aligned
    power-of-two intervals of ranks that cover it; two ranges overlap exactly if an
    interval of one contains an interval of the other.  Leftmost right edge and rightmost
    left edge per interval decide, so no pairs of boxes are formed.
    """
    box = F.col("box")
    boxes = placed.where(
        box.isNotNull() & (box["right"] - box["left"] < F.col("width") * 0.6)
    ).select(
        "doc_id", "pdf_page", (F.col("width") * 0.05).alias("_gap"),
        box["left"].alias("_left"), box["right"].alias("_right"), box["top"].alias("_top"), box["bottom"].alias("_bottom"),
    )
    edges = boxes.select("doc_id", "pdf_page", F.explode(F.array("_top", "_bottom")).alias("_edge")).distinct()
    # One page's edges at a time.
    ranked = edges.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("doc_id", "pdf_page").orderBy("_edge")).cast("bigint") - 1
    ).withColumn("_edges", F.count("*").over(Window.partitionBy("doc_id", "pdf_page")))
    tops = ranked.select("doc_id", "pdf_page", F.col("_edge").alias("_top"), F.col("_rank").alias("_a"), "_edges")
    bottoms = ranked.select("doc_id", "pdf_page", F.col("_edge").alias("_bottom"), F.col("_rank").alias("_z"))
    narrow = (
        boxes.join(tops, ["doc_id", "pdf_page", "_top"])
        .join(bottoms, ["doc_id", "pdf_page", "_bottom"])
        .withColumn("_levels", F.ceil(F.log2("_edges")).cast("int"))
    )
    levels = F.col("_levels")

    def size_of(level):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)

    step = size_of(F.col("_k"))
    cut = narrow.withColumn("_k", F.explode(F.sequence(F.lit(0), levels))).select(
        "*",
        int_div(F.col("_a") + step - 1, step).alias("_low"),
        int_div(F.col("_z"), step).alias("_high"),
    )
    low, high = F.col("_low"), F.col("_high")
    cover = cut.withColumn(
        "_i",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((low % 2 == 1) & (low < high), low),
                    F.when((high % 2 == 1) & (high - 1 >= low), high - 1),
                )
            )
        ),
    )
    # Each covering interval also tells the intervals that contain it.
    nodes = cover.withColumn("_up", F.explode(F.sequence(F.col("_k"), levels))).select(
        "doc_id", "pdf_page", "_gap", "_left", "_right",
        F.col("_up").alias("_level"),
        int_div(F.col("_i"), size_of(F.col("_up") - F.col("_k"))).alias("_node"),
        (F.col("_up") == F.col("_k")).alias("_covers"),
    )
    covers = F.col("_covers")
    extremes = nodes.groupBy("doc_id", "pdf_page", "_level", "_node").agg(
        F.max("_gap").alias("_gap"),
        (F.max("_left") - F.min(F.when(covers, F.col("_right")))).alias("_d1"),
        (F.max(F.when(covers, F.col("_left"))) - F.min("_right")).alias("_d2"),
    )
    return (
        extremes.where(F.greatest("_d1", "_d2") > F.col("_gap")).select("doc_id", "pdf_page").distinct()
    )


def visual_captions(visuals: DataFrame, items: DataFrame) -> DataFrame:
    """Caption of each visual from its ``caption_refs``, in reference order, with an issue code.

    ``items`` are all parsed items (doc_id, pos, text, pdf_page) with ``mapped``
    true for those that became a block on a page.
    """
    refs = visuals.select("doc_id", "pos", "pdf_page", F.posexplode_outer("caption_refs").alias("_nth", "_ref"))
    known = items.select(
        "doc_id", F.col("pos").alias("_ref"), F.col("text").alias("_text"),
        F.col("pdf_page").alias("_page"), "mapped",
    )
    joined = refs.join(known, ["doc_id", "_ref"], "left")
    text = strip(F.col("_text"))
    # A visual refers to a handful of captions.
    grouped = joined.groupBy("doc_id", "pos", "pdf_page").agg(
        F.array_sort(F.collect_list(F.when(text != "", F.struct("_nth", text.alias("t"))))).alias("_texts"),
        F.count_if("mapped").alias("caption_blocks"),
        (F.min("_page") != F.max("_page")).alias("_spread"),
        F.bool_or(F.col("_page") != F.col("pdf_page")).alias("_elsewhere"),
    )
    raw = F.array_join(F.transform("_texts", lambda e: e["t"]), " ")
    found, anchored = raw != "", F.col("caption_blocks") > 0
    return grouped.select(
        "doc_id", "pos", "pdf_page", "caption_blocks",
        F.when(found & anchored, raw).alias("caption"),
        F.when(found & ~anchored, "caption_source_not_mapped")
        .when(~found, "caption_not_found").alias("caption_issue"),
        (F.coalesce("_spread", F.lit(False)) | F.coalesce("_elsewhere", F.lit(False))).alias("cross_page"),
    )


def text_layer_status(pages: DataFrame) -> DataFrame:
    """Status of a document from its pages: ready unless every page lacks text."""
    absent = F.col("text_chars") == 0
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(absent).alias("pages_without_text"),
        F.when(~F.bool_and(absent), "ready")
        .when(F.bool_or(F.col("image_count") > 0), "scanned")
        .otherwise("no_text")
        .alias("status"),
    )
