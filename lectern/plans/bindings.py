"""The relations of the engine, read from the star-schema and text tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few partitions over all cores before costly work per row.

    A file with one row group is read by one task.  Tables with at least as many
    splits as there are cores are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def interests(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .where("label = 0")
        .select(F.col("vec_id").alias("paper_id"), "embedding")
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .where("label <> 0")
        .select(F.col("vec_id").alias("paper_id"), "embedding", "label")
    )


def focus(spark: SparkSession, folder: str) -> DataFrame:
    """The oldest interest serves as the explicit research focus."""
    rows = interests(spark, folder)
    return rows.agg(F.min_by("embedding", "paper_id").alias("embedding"))


def as_commands(events: DataFrame) -> DataFrame:
    """Events as reader commands on the paper named in their JSON properties."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "set_read")
        .when(kind.isin("purchase", "click"), "set_favorite")
        .otherwise("set_irrelevant")
    )
    return events.select(
        F.get_json_object("props", "$.k").cast("bigint").alias("paper_id"),
        action.alias("action"),
        kind.isin("view", "purchase", "error").alias("value"),
        F.col("ts").alias("occurred_at"),
        F.col("user_id").alias("device_id"),
        F.col("event_id").alias("sequence"),
        F.col("event_id").alias("command_id"),
    )


def commands(spark: SparkSession, folder: str) -> DataFrame:
    return as_commands(table(spark, folder, "events"))


COMMANDS_SQL = """
commands AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS paper_id,
         CASE WHEN event_type = 'view' THEN 'set_read'
              WHEN event_type IN ('purchase', 'click') THEN 'set_favorite'
              ELSE 'set_irrelevant' END AS action,
         event_type IN ('view', 'purchase', 'error') AS value,
         ts AS occurred_at, user_id AS device_id, event_id AS sequence, event_id AS command_id
  FROM events)"""

STATE_SQL = (
    COMMANDS_SQL
    + """,
logged AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id
            ORDER BY occurred_at, device_id, sequence, command_id) AS pos
  FROM commands),
state AS (
  SELECT paper_id,
    coalesce(arg_max(value, pos) FILTER (WHERE action = 'set_read'), false) AS read,
    coalesce(arg_max(action = 'set_favorite' AND value, pos)
      FILTER (WHERE action = 'set_favorite' OR (action = 'set_irrelevant' AND value)), false) AS favorite,
    coalesce(arg_max(action = 'set_irrelevant' AND value, pos)
      FILTER (WHERE action = 'set_irrelevant' OR (action = 'set_favorite' AND value)), false) AS irrelevant,
    max(occurred_at) FILTER (WHERE action = 'set_read') AS read_watermark,
    max(occurred_at) FILTER (WHERE action <> 'set_read') AS preference_watermark
  FROM logged GROUP BY paper_id)"""
)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document, in reading order."""
    split = documents(spark, folder).withColumn("parts", F.split("text", "\n"))
    return split.select(
        "doc_id", "lang", "source", F.size("parts").alias("item_count"),
        F.posexplode("parts").alias("pos", "line"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


LINES_SQL = """
lines AS (
  SELECT doc_id, lang, source, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) s,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u)"""


def rounded(column: str | Column, places: int = 6) -> Column:
    # Adding zero turns a rounded -0.0 into 0.0.
    return F.round(F.col(column) if isinstance(column, str) else column, places) + 0.0


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as parsed layout items: short lines are headings, places follow from the order."""
    n, pos = F.length("line"), F.col("pos")
    heading = n.between(1, 39)
    label = (
        F.when(heading, "section_header")
        .when(pos % 13 == 4, "table")
        .when(pos % 13 == 8, "picture")
        .when(pos % 11 == 5, "caption")
        .when(pos % 11 == 7, "list_item")
        .when(pos % 11 == 9, "formula")
        .when(pos % 17 == 3, "page_footer")
        .otherwise("text")
    )
    top = (pos % 30) * 25 + 4
    height = 8 + n % 40
    flipped = pos % 3 == 0
    left = 30 + (pos % 2) * 280
    width = F.when((n % 50 == 0) | (heading & (n % 17 == 0)), 900).otherwise(60 + n % 260)
    return lines(spark, folder).select(
        "doc_id", "pos", "item_count", F.col("line").alias("text"), label.alias("label"),
        (1 + n % 3).alias("level"),
        (F.floor(pos / 30) + 1).cast("bigint").alias("pdf_page"),
        left.cast("double").alias("raw_left"),
        F.when(flipped, 792 - top).otherwise(top).cast("double").alias("raw_top"),
        (left + width).cast("double").alias("raw_right"),
        F.when(flipped, 792 - top - height).otherwise(top + height).cast("double").alias("raw_bottom"),
        F.when(flipped, "bottom_left").otherwise("top_left").alias("origin"),
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    odd = F.col("doc_id") % 2 == 1
    return items(spark, folder).groupBy("doc_id", "pdf_page").agg(
        F.sum(F.when(F.col("label") == "section_header", 0).otherwise(F.length("text"))).alias("text_chars"),
        F.count_if(F.col("label").isin("table", "picture")).alias("image_count"),
    ).select(
        "*",
        F.when(odd, 595.0).otherwise(612.0).alias("width"),
        F.when(odd, 842.0).otherwise(792.0).alias("height"),
    )


ITEMS_SQL = (
    LINES_SQL
    + """,
base AS (SELECT doc_id, pos, line AS text, length(line) AS n, pos // 30 + 1 AS pdf_page, 1 + length(line) % 3 AS level,
   CASE WHEN length(line) BETWEEN 1 AND 39 THEN 'section_header' WHEN pos % 13 = 4 THEN 'table' WHEN pos % 13 = 8 THEN 'picture'
        WHEN pos % 11 = 5 THEN 'caption' WHEN pos % 11 = 7 THEN 'list_item' WHEN pos % 11 = 9 THEN 'formula'
        WHEN pos % 17 = 3 THEN 'page_footer' ELSE 'text' END AS label,
   CASE WHEN doc_id % 2 = 1 THEN 595.0 ELSE 612.0 END AS width, CASE WHEN doc_id % 2 = 1 THEN 842.0 ELSE 792.0 END AS height FROM lines),
items AS (SELECT *, CAST(30 + (pos % 2) * 280 AS DOUBLE) AS bl,
   CAST((pos % 30) * 25 + 4 + CASE WHEN pos % 3 = 0 THEN height - 792 ELSE 0 END AS DOUBLE) AS bt,
   CAST(30 + (pos % 2) * 280 + CASE WHEN n % 50 = 0 OR (label = 'section_header' AND n % 17 = 0) THEN 900 ELSE 60 + n % 260 END AS DOUBLE) AS br,
   CAST((pos % 30) * 25 + 4 + 8 + n % 40 + CASE WHEN pos % 3 = 0 THEN height - 792 ELSE 0 END AS DOUBLE) AS bb FROM base),
placed AS (SELECT *, bl >= 0 AND bt >= 0 AND br <= width AND bb <= height AS ok FROM items),
heads AS (SELECT doc_id, pos, level, text FROM placed WHERE ok AND label = 'section_header'
          AND regexp_replace(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') <> '')"""
)
