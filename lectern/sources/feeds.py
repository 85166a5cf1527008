"""Metadata from Atom feeds, preprint listings and offline files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import PAPER_ID_IN_URL, collapse, not_blank, strip
from lectern.operators.dedup import canonical, latest_date_only, latest_version
from lectern.schemas import ATOM_ENTRY, COLLECTION, LIBRARY_ITEM, OFFLINE_FIXTURE, PREPRINT_RESPONSE
from lectern.sources.registry import register


_ITEM_ENTRY = "key string, data struct<itemType: string, title: string, abstractNote: string, collections: array<string>, dateAdded: string>"


def read_library(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Collections and items of an exported interest library."""
    collections = spark.read.schema(COLLECTION).json(f"{folder}/collections")
    items = spark.read.schema(LIBRARY_ITEM).json(f"{folder}/items")
    return collections, items


# The kinds of library items that count as papers.
PAPER_ITEM_TYPES = ("conferencePaper", "journalArticle", "preprint")


def library_items(raw: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Items of the paper kinds from JSON entries as the library service returns them, and how many were malformed.

    An entry without a key, its data, a kind or a readable date of addition is malformed; the
    second frame is one row with the counts ``items``, ``other_kinds`` and ``malformed``.
    Missing titles and abstracts are empty, missing collections an empty list.
    """
    parsed = raw.select(F.from_json(payload, _ITEM_ENTRY).alias("e"))
    data = F.col("e.data")
    moment = F.try_to_timestamp(data["dateAdded"])
    kind = F.coalesce(data["itemType"].isin(*PAPER_ITEM_TYPES), F.lit(False))
    good = F.col("e.key").isNotNull() & data.isNotNull() & moment.isNotNull()
    state = (
        F.when(data["itemType"].isNotNull() & ~kind, "other_kinds").when(F.coalesce(good, F.lit(False)) & kind, "items").otherwise("malformed")
    )
    # An explode keeps the filter below from parsing every entry a second time.
    judged = parsed.select(F.explode(F.array(F.struct(
        state.alias("state"), F.col("e.key").alias("key"), F.coalesce(data["title"], F.lit("")).alias("title"),
        F.coalesce(data["abstractNote"], F.lit("")).alias("abstract"),
        F.coalesce(data["collections"], F.array().cast("array<string>")).alias("collection_keys"), moment.alias("added_at"),
    ))).alias("i")).select("i.*")
    counts = judged.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("items", "other_kinds", "malformed")])
    return judged.where("state = 'items'").drop("state"), counts


@register("atom")
def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed entries; an entry that does not parse keeps its text in ``_corrupt_record``."""
    return (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(ATOM_ENTRY)
        .load(path)
    )


def _moment(text: Column) -> Column:
    return F.try_to_timestamp(text)


def parse_entries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid metadata entries, and the rejected raw entries."""
    base = F.regexp_extract("id", PAPER_ID_IN_URL, 1)
    version = F.coalesce(F.regexp_extract("id", PAPER_ID_IN_URL, 2).try_cast("bigint"), F.lit(1).cast("bigint"))
    categories = canonical(F.transform("category", lambda c: c["_term"]))
    linked = F.filter("link", lambda x: (x["_type"] == "application/pdf") | (x["_title"] == "pdf"))
    with_version = F.concat(base, F.lit("v"), version.cast("string"))
    parsed = raw.select(
        "*",
        F.nullif(base, F.lit("")).alias("arxiv_id"),
        version.alias("version"),
        categories.alias("categories"),
        _moment(F.col("published")).alias("published_at"),
        _moment(F.col("updated")).alias("updated_at"),
        F.concat(F.lit("https://arxiv.org/abs/"), with_version).alias("arxiv_url"),
        F.coalesce(
            F.get(linked, F.lit(0))["_href"], F.concat(F.lit("https://arxiv.org/pdf/"), with_version)
        ).alias("pdf_url"),
    ).withColumn(
        "primary_category",
        F.coalesce(F.col("`arxiv:primary_category`")["_term"], F.get("categories", F.lit(0))),
    )
    valid = (
        F.col("arxiv_id").isNotNull()
        & F.col("_corrupt_record").isNull()
        & not_blank(F.col("title")) & not_blank(F.col("summary"))
        & F.col("published_at").isNotNull() & F.col("updated_at").isNotNull()
        & F.col("primary_category").isNotNull()
    )
    marked = parsed.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    entries = marked.where("_valid").select(
        F.concat(F.lit("arxiv:"), "arxiv_id").alias("paper_id"),
        "arxiv_id", "version",
        collapse(F.col("title")).alias("title"),
        F.transform("author", lambda a: collapse(a["name"])).alias("authors"),
        collapse(F.col("summary")).alias("abstract"),
        "categories", "primary_category", "published_at", "updated_at", "arxiv_url", "pdf_url",
        F.lit(None).cast("string").alias("code_url"),
        F.coalesce(F.col("`arxiv:announce_type`"), F.lit("new")).alias("announce_type"),
    )
    return entries, marked.where("NOT _valid").select(*raw.columns)


def announced(entries: DataFrame, include_cross_list: bool) -> DataFrame:
    kinds = ("new", "cross") if include_cross_list else ("new",)
    return entries.where(F.col("announce_type").isin(*kinds))


def in_categories(entries: DataFrame, categories: Sequence[str], include_cross_list: bool) -> DataFrame:
    return entries if include_cross_list else entries.where(F.col("primary_category").isin(*categories))


def latest_entries(entries: DataFrame) -> DataFrame:
    """One entry per paper: the highest version, then the latest update."""
    order = [F.col("version"), F.col("updated_at"), F.col("published_at"), F.xxhash64("title", "abstract")]
    return latest_version(entries, ["arxiv_id"], order)


def category_feeds(
    feeds: Sequence[DataFrame],
    categories: Sequence[str],
    include_cross_list: bool,
    limit: int | None,
    limit_first: bool = False,
) -> DataFrame:
    """Feeds of several categories as one: latest versions by the category rule, the newest ``limit`` of them.

    ``limit`` None keeps all; ``limit_first`` takes the newest before the category rule.
    """
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed)
    latest = latest_entries(merged)
    wanted = latest if limit_first else in_categories(latest, categories, include_cross_list)
    if limit is not None:
        wanted = wanted.orderBy(F.desc("published_at"), F.desc("updated_at"), F.desc("arxiv_id")).limit(limit)
    return in_categories(wanted, categories, include_cross_list)


@register("preprints")
def read_preprints(spark: SparkSession, path: str, server: str, categories: Sequence[str]) -> DataFrame:
    """The latest day of a preprint server's listing, in the wanted categories."""
    listing = spark.read.schema(PREPRINT_RESPONSE).option("multiLine", True).json(path)
    rows = listing.select(F.explode("collection").alias("p")).select("p.*")
    return preprint_papers(rows, server, categories)[0]


def preprint_papers(rows: DataFrame, server: str, categories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Papers of the latest day in the wanted categories, and the wanted rows that make no paper with their ``reason``.

    A row must name its title, authors, abstract, DOI and version; the first that is
    missing is the reason.  Rows of other days or categories are neither.
    """
    latest = latest_date_only(rows, "date").where(F.col("category").isin(*[c.lower() for c in categories]))
    needed = ("title", "authors", "abstract", "doi", "version")
    reason = F.coalesce(*[F.when(F.col(name).isNull(), f"{name}_missing") for name in needed])
    judged = latest.withColumn("reason", reason)
    rejected = judged.where("reason IS NOT NULL").select(F.lit(server).alias("source"), *needed, "date", "category", "reason")
    wanted = judged.where("reason IS NULL")
    url = F.concat(F.lit(f"https://www.{server}.org/content/"), "doi", F.lit("v"), "version", F.lit(".full.pdf"))
    papers = wanted.select(
        F.lit(server).alias("source"), "title",
        F.transform(F.split("authors", ";"), lambda a: strip(a)).alias("authors"),
        "abstract", url.alias("url"), url.alias("pdf_url"), F.lit(None).cast("string").alias("full_text"),
    )
    return papers, rejected


def read_offline_fixture(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collections, items, entries and embeddings of one offline file."""
    whole = spark.read.schema(OFFLINE_FIXTURE).option("multiLine", True).json(path)
    tables = {
        name: whole.select(F.explode(name).alias("r")).select("r.*")
        for name in ("collections", "items", "arxiv_entries")
    }
    tables["embeddings"] = whole.select(F.explode("embeddings").alias("text", "embedding"))
    return tables
