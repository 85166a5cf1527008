"""All rules of a document graph as bit masks over its elements.

Every reference of the graph is an edge: blocks, sections and regions to pages; pages,
sections and captions to blocks; blocks, sections and visuals to sections.  Edges of one
kind are put into one relation, so each is shuffled once, to the facts it refers to, and
leaves a mask of the rules it breaks.  Masks are rolled up with ``bit_or`` per element and
named at the end.  Facts and edges only meet in joins and in aggregates that combine before
the shuffle, so a document that holds a large part of all blocks is not gathered anywhere.
Blocks and what points to them are many narrow rows that compress to a few bytes each, so
their partitions follow from the number of rows and not from the size of the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.constraints import differs
from lectern.operators.hierarchy import CYCLE, ancestor_paths

RULES = (
    "page_number_not_unique", "pages_do_not_cover_document", "block_id_not_unique", "section_id_not_unique",
    "visual_id_not_unique", "page_lists_unknown_block", "block_outside_page", "block_not_once_on_its_page",
    "block_source_mismatch", "block_parser_mismatch", "dangling_section_reference", "dangling_parent_reference",
    "section_lists_unknown_block", "section_beyond_document", "section_range_mismatch", "section_source_unresolved",
    "section_parser_mismatch", "membership_not_in_block", "membership_not_in_section", "section_parent_cycle",
    "visual_section_unknown", "caption_block_unknown", "caption_block_of_other_type", "caption_without_block",
    "region_outside_page", "region_source_mismatch", "region_parser_mismatch", "image_outside_evidence_root",
)

#: Blocks and edges to blocks that one task sorts and counts.
ROWS_PER_TASK = 500_000


@dataclass(frozen=True)
class Graph:
    """The relations of document graphs; all have ``doc_id``.

    A box is a struct of left, top, right and bottom, a source a struct of pdf_page, box,
    parser and parser_version.  Ids may be of any type that casts to a string.

    * documents: page_count, parser, parser_version, evidence_root; unique
    * pages: pdf_page, width, height; page_blocks: pdf_page, block_id
    * blocks: block_id, block_type, pdf_page, box, section_id, source
    * sections: section_id, parent_id, start_pdf_page, end_pdf_page, source; section_blocks: section_id, block_id
    * visuals: visual_id, section_id, caption; caption_blocks: visual_id, block_id
    * regions: visual_id, nth, pdf_page, box, source, image_path
    """

    documents: DataFrame
    pages: DataFrame
    page_blocks: DataFrame
    blocks: DataFrame
    sections: DataFrame
    section_blocks: DataFrame
    visuals: DataFrame
    caption_blocks: DataFrame
    regions: DataFrame


def _mask(**rules: Column) -> Column:
    mask = F.lit(0).cast("bigint")
    for name, broken in rules.items():
        mask = mask.bitwiseOR(F.when(F.coalesce(broken, F.lit(False)), 1 << RULES.index(name)).otherwise(0).cast("bigint"))
    return mask


def _masks(df: DataFrame, kind: str | Column, element: str | Column, **rules: Column) -> DataFrame:
    name = F.col(element) if isinstance(element, str) else element
    label = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("doc_id", label.alias("kind"), name.cast("string").alias("element"), _mask(**rules).alias("mask")).where("mask <> 0")


def _region_name() -> Column:
    return F.concat_ws("#", F.col("visual_id").cast("string"), F.col("nth").cast("string")).alias("element")


def path_within(path: Column, root: Column) -> Column:
    """Whether ``path`` lies at or below ``root`` once ``.`` and ``..`` are worked out; null if either is."""

    def steps(text: Column) -> Column:
        start = F.array().cast("array<string>")
        return F.aggregate(
            F.split(text, "/"), start,
            lambda above, part: F.when(part.isin("", "."), above)
            .when(part == "..", F.slice(above, F.lit(1), F.greatest(F.size(above) - 1, F.lit(0))))
            .otherwise(F.concat(above, F.array(part))),
        )

    inner, outer = steps(path), steps(root)
    rooted = path.startswith("/") == root.startswith("/")
    return rooted & (F.slice(inner, F.lit(1), F.greatest(F.size(outer), F.lit(0))) == outer)


def _page_masks(g: Graph) -> DataFrame:
    facts = g.pages.groupBy("doc_id", "pdf_page").agg(
        F.count("*").alias("_n"), F.max("width").alias("_width"), F.max("height").alias("_height")
    )
    own = g.sections.select(
        "doc_id", F.lit("section").alias("kind"), F.col("section_id").cast("string").alias("element"),
        F.col("source.pdf_page").alias("pdf_page"), F.col("source.box").alias("box"),
        F.col("source.pdf_page").between(F.col("start_pdf_page"), F.col("end_pdf_page")).alias("_in_range"),
    )
    blocks = g.blocks.select(
        "doc_id", F.lit("block").alias("kind"), F.col("block_id").cast("string").alias("element"), "pdf_page", "box", F.lit(True).alias("_in_range")
    )
    regions = g.regions.select(
        "doc_id", F.lit("region").alias("kind"), _region_name(), "pdf_page", "box", F.lit(True).alias("_in_range")
    )
    placed = blocks.unionByName(own).unionByName(regions).join(facts, ["doc_id", "pdf_page"], "left")
    inside = F.coalesce(
        (F.col("box.left") >= 0) & (F.col("box.top") >= 0)
        & (F.col("box.right") <= F.col("_width")) & (F.col("box.bottom") <= F.col("_height")),
        F.lit(False),
    )
    kind = F.col("kind")
    boxes = _masks(
        placed, kind, "element",
        block_outside_page=(kind == "block") & ~inside,
        region_outside_page=(kind == "region") & ~inside,
        section_source_unresolved=(kind == "section") & ~(inside & F.coalesce("_in_range", F.lit(False))),
    )
    return boxes.unionByName(_masks(facts, "page", "pdf_page", page_number_not_unique=F.col("_n") > 1))


def _block_partitions(g: Graph) -> int:
    """How many partitions blocks and the edges to them are dealt to."""
    many = (g.blocks, g.page_blocks, g.section_blocks, g.caption_blocks)
    rows = reduce(DataFrame.unionAll, [df.select(F.lit(1)) for df in many]).count()
    return max(1, -(-rows // ROWS_PER_TASK))


def _block_masks(g: Graph) -> DataFrame:
    keys, partitions = ["doc_id", "block_id"], _block_partitions(g)
    # Null ids match nothing and are not judged as blocks.  Dealt before they are grouped: hardly an id comes twice.
    facts = g.blocks.where("doc_id IS NOT NULL AND block_id IS NOT NULL").select(*keys, "pdf_page", "section_id", "block_type").repartition(
        partitions, *keys
    ).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("pdf_page").alias("_page"), F.min("section_id").alias("_section"),
        F.min("block_type").alias("_type"),
    )
    section_type, visual_type = g.sections.schema["section_id"].dataType, g.visuals.schema["visual_id"].dataType
    none = {"_on": F.lit(None).cast("bigint"), "_in": F.lit(None).cast(section_type), "_of": F.lit(None).cast(visual_type)}

    def edges(df: DataFrame, kind: str, **owner: Column) -> DataFrame:
        ends = {**none, **owner}
        return df.select("doc_id", "block_id", F.lit(kind).alias("_kind"), *[c.alias(n) for n, c in ends.items()])

    listed = (
        edges(g.page_blocks, "page", _on=F.col("pdf_page").cast("bigint"))
        .unionByName(edges(g.section_blocks, "section", _in=F.col("section_id")))
        .unionByName(edges(g.caption_blocks, "caption", _of=F.col("visual_id")))
    ).repartition(partitions, *keys)
    # A block that nothing points to stays as a row without a kind.
    resolved = listed.join(facts, keys, "full")
    kind, unknown = F.col("_kind"), F.col("_n").isNull()
    owners = F.when(kind == "page", F.col("_on").cast("string")).when(kind == "section", F.col("_in").cast("string")).otherwise(F.col("_of").cast("string"))
    by_owner = _masks(
        resolved.where("_kind IS NOT NULL"), F.when(kind == "caption", "visual").otherwise(kind), owners,
        page_lists_unknown_block=(kind == "page") & unknown,
        section_lists_unknown_block=(kind == "section") & unknown,
        membership_not_in_block=(kind == "section") & ~unknown & differs(F.col("_in"), F.col("_section")),
        caption_block_unknown=(kind == "caption") & unknown,
        caption_block_of_other_type=(kind == "caption") & differs(F.col("_type"), F.lit("caption")) & ~unknown,
    )
    per_block = resolved.where("_n IS NOT NULL").groupBy("doc_id", "block_id").agg(
        F.max("_n").alias("_n"),
        F.count_if(kind == "page").alias("_pages"),
        F.count_if((kind == "page") & (F.col("_on") == F.col("_page"))).alias("_right_pages"),
        F.bool_or(F.col("_section").isNotNull()).alias("_owned"),
        F.count_if((kind == "section") & (F.col("_in") == F.col("_section"))).alias("_members"),
    )
    by_block = _masks(
        per_block, "block", "block_id",
        block_id_not_unique=F.col("_n") > 1,
        block_not_once_on_its_page=(F.col("_pages") != 1) | (F.col("_right_pages") != 1),
        membership_not_in_section=F.col("_owned") & (F.col("_members") == 0),
    )
    spans = resolved.where("_kind = 'section' AND _n IS NOT NULL").groupBy("doc_id", F.col("_in").alias("section_id")).agg(
        F.min("_page").alias("_first"), F.max("_page").alias("_last")
    )
    ranged = _masks(
        g.sections.select("doc_id", "section_id", "start_pdf_page", "end_pdf_page").join(spans, ["doc_id", "section_id"]), "section", "section_id",
        section_range_mismatch=differs(F.col("start_pdf_page"), F.col("_first")) | differs(F.col("end_pdf_page"), F.col("_last")),
    )
    return by_owner.unionByName(by_block).unionByName(ranged)


def _section_masks(g: Graph) -> DataFrame:
    facts = g.sections.groupBy("doc_id", "section_id").agg(F.count("*").alias("_n"))
    references = None
    for df, kind, name, target in (
        (g.blocks, "block", "block_id", "section_id"), (g.sections, "section", "section_id", "parent_id"), (g.visuals, "visual", "visual_id", "section_id"),
    ):
        part = df.where(F.col(target).isNotNull()).select(
            "doc_id", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("element"), F.col(target).alias("section_id")
        )
        references = part if references is None else references.unionByName(part)
    kind, unknown = F.col("kind"), F.col("_n").isNull()
    dangling = _masks(
        references.join(facts, ["doc_id", "section_id"], "left"), kind, "element",
        dangling_section_reference=(kind == "block") & unknown,
        dangling_parent_reference=(kind == "section") & unknown,
        visual_section_unknown=(kind == "visual") & unknown,
    )
    repeated = _masks(facts, "section", "section_id", section_id_not_unique=F.col("_n") > 1)

    def key(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col(column).cast("string")))

    # A repeated section id counts once, under its least parent.
    nodes = g.sections.where(F.col("section_id").isNotNull()).groupBy("doc_id", "section_id").agg(F.min("parent_id").alias("parent_id"))
    keyed = nodes.select(key("section_id").alias("key"), key("parent_id").alias("parent"), F.lit("").alias("name"))
    loops = ancestor_paths(keyed, "key", "parent", "name").where(F.col("status") == CYCLE).select("key")
    cyclic = _masks(
        nodes.withColumn("key", key("section_id")).join(loops, "key", "left_semi"), "section", "section_id", section_parent_cycle=F.lit(True)
    )
    return dangling.unionByName(repeated).unionByName(cyclic)


def _document_masks(g: Graph) -> DataFrame:
    """Rules against the document itself, and those within one element."""
    covered = g.pages.groupBy("doc_id").agg(
        F.countDistinct("pdf_page").alias("_pages"), F.min("pdf_page").alias("_first"), F.max("pdf_page").alias("_last")
    )
    cover = _masks(
        g.documents.select("doc_id", "page_count").join(covered, "doc_id", "left"), "document", F.lit(""),
        pages_do_not_cover_document=(F.coalesce("_pages", F.lit(0)) != F.col("page_count"))
        | F.coalesce((F.col("_first") != 1) | (F.col("_last") != F.col("page_count")), F.lit(False)),
    )
    nothing, no_page = F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("bigint").alias("_end")

    def stated(df: DataFrame, kind: str, element: Column, end: Column = no_page, image: Column = nothing, own_page: bool = True) -> DataFrame:
        moved = differs(F.col("source.pdf_page"), F.col("pdf_page")) | differs(F.col("source.box"), F.col("box")) if own_page else F.lit(False)
        return df.select(
            "doc_id", F.lit(kind).alias("kind"), element.cast("string").alias("element"),
            F.col("source.parser").alias("_parser"), F.col("source.parser_version").alias("_version"), end, image, moved.alias("_moved"),
        )

    elements = (
        stated(g.blocks, "block", F.col("block_id"))
        .unionByName(stated(g.sections, "section", F.col("section_id"), F.col("end_pdf_page").cast("bigint").alias("_end"), own_page=False))
        .unionByName(stated(g.regions, "region", _region_name(), image=F.col("image_path")))
    )
    joined = elements.join(g.documents.select("doc_id", "page_count", "parser", "parser_version", "evidence_root"), "doc_id", "left")
    kind = F.col("kind")
    other = differs(F.col("_parser"), F.col("parser")) | differs(F.col("_version"), F.col("parser_version"))
    inside = F.coalesce(path_within(F.col("image_path"), F.col("evidence_root")), F.lit(False))
    against = _masks(
        joined, kind, "element",
        block_parser_mismatch=(kind == "block") & other,
        section_parser_mismatch=(kind == "section") & other,
        region_parser_mismatch=(kind == "region") & other,
        section_beyond_document=F.col("_end") > F.col("page_count"),
        image_outside_evidence_root=F.col("image_path").isNotNull() & ~inside,
        block_source_mismatch=(kind == "block") & F.col("_moved"),
        region_source_mismatch=(kind == "region") & F.col("_moved"),
    )
    captioned = g.caption_blocks.select("doc_id", "visual_id").distinct().withColumn("_has", F.lit(True))
    visuals = g.visuals.groupBy("doc_id", "visual_id").agg(F.count("*").alias("_n"), F.bool_or(F.col("caption").isNotNull()).alias("_caption"))
    bare = _masks(
        visuals.join(captioned, ["doc_id", "visual_id"], "left"), "visual", "visual_id",
        visual_id_not_unique=F.col("_n") > 1,
        caption_without_block=F.col("_caption") & F.col("_has").isNull(),
    )
    return cover.unionByName(against).unionByName(bare)


def graph_masks(graph: Graph) -> DataFrame:
    """``doc_id, kind, element, mask`` for every element that breaks a rule; bit k stands for ``RULES[k]``.

    ``kind`` is document, page, block, section, visual or region.  All rules are judged on all
    elements, also where an earlier one is broken.  Of repeated pages the largest size counts,
    of repeated blocks the least page, section and type.  Elements of a document that is not in
    ``documents`` have another parser.  Null ids match nothing.
    """
    parts = _page_masks(graph).unionByName(_block_masks(graph)).unionByName(_section_masks(graph)).unionByName(_document_masks(graph))
    return parts.groupBy("doc_id", "kind", "element").agg(F.bit_or("mask").alias("mask"))


def named(masks: DataFrame) -> DataFrame:
    """One row ``doc_id, kind, element, code`` per broken rule."""
    codes = F.array_compact(F.array(*[
        F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, name) for k, name in enumerate(RULES)
    ]))
    return masks.select("doc_id", "kind", "element", F.explode(codes).alias("code"))
