"""Queries over the keyed, cursor and fallback sources and the statuses of downloads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.plans import bindings as b
from lectern.sources import bundles, downloads, lookups, snapshots

SERVICE = "lectern.sources.table_service"
EVENT_TYPES = ["view", "signup", "click", "error", "purchase"]


def batched_lookup(spark, folder):
    """Every labelled document, asked for by id in batches of twenty."""
    arguments = {"path": f"{folder}/documents.parquet", "key": "doc_id", "columns": ["doc_id", "lang", "source"]}
    return lookups.lookup(
        b.table(spark, folder, "labels"), "doc_id", f"{SERVICE}:by_ids", "doc_id bigint, lang string, source string", arguments
    )


def cursor_listing(spark, folder):
    """All events, one listing per type, page by page without a total."""
    lookups.install(spark)
    arguments = {
        "path": f"{folder}/events.parquet", "field": "event_type", "page_size": 500,
        "columns": ["event_id", "event_type", "user_id"],
    }
    reader = spark.read.format("cursor_listing").schema("event_id bigint, event_type string, user_id bigint")
    reader = reader.option("fetcher", f"{SERVICE}:by_cursor").option("arguments", json.dumps(arguments))
    return reader.option("listings", json.dumps(EVENT_TYPES)).load()


def metadata_legs(spark, folder):
    """Returned lines as snapshots of their supplier's listing, the other lines as requests for it."""
    lines = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag"
    )
    kind = F.col("l_linenumber") % 4
    api = F.when(kind == 0, "answered").when(kind == 1, "refused").otherwise("unavailable")
    requests = lines.where("l_returnflag <> 'R'").withColumn("asked_at", F.col("l_shipdate") + F.expr("INTERVAL 9 HOUR"))
    taken = lines.where("l_returnflag = 'R'")
    legs = snapshots.chosen_legs(requests, taken, "l_suppkey", "asked_at", "l_shipdate", api, F.col("l_quantity") < 10)
    return legs.select("l_orderkey", "l_linenumber", "l_suppkey", "asked_at", "l_quantity", "leg", "snapshot_at")


def bundle_scan(spark, folder):
    """Every hundred events as one exported bundle, some of them altered, cut, reordered or too long."""
    n = F.floor(F.col("event_id") / 100)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    command = F.struct(
        F.col("event_type").alias("action"), F.concat(F.lit("c"), "event_id").alias("command_id"), F.col("user_id").cast("string").alias("device_id"),
        at.alias("occurred_at"), F.get_json_object("props", "$.k").alias("paper_id"), F.col("event_id").alias("sequence"), (F.col("value") > 50).alias("value"),
    )
    events = b.table(spark, folder, "events").where("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL")
    # A bundle holds at most a hundred events, as event ids are unique.
    grouped = events.groupBy(n.alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("ts", F.col("user_id").cast("string").alias("d"), "event_id", command.alias("c")))).alias("rows")
    )
    k = F.col("n") % 11
    ordered = F.transform("rows", lambda r: r["c"])
    commands = F.when(k == 3, F.reverse(ordered)).when(k == 4, F.concat(F.slice(ordered, 1, 1), ordered)).otherwise(ordered)
    body = grouped.select("n", F.when(k == 7, F.lit(None)).otherwise(F.concat(F.lit("b"), "n")).alias("bundle_id"), commands.alias("commands"))
    fixed = [F.lit("2024-12-31T00:00:00Z").alias("generated_at"), F.lit("1").alias("schema_version")]
    digest = F.sha2(F.to_json(F.struct("bundle_id", "commands", *fixed)), 256)
    stated = F.when(k == 1, F.reverse(digest)).otherwise(digest).alias("digest")
    # Other order of keys: the digest must not depend on it.
    text = F.to_json(F.struct(stated, *reversed(fixed), "commands", "bundle_id"))
    content = F.encode(F.when(k == 2, F.substring(text, 1, 500)).when(k == 5, F.concat(text, F.repeat(F.lit(" "), 1_000_000))).otherwise(text), "utf-8")
    large = F.octet_length("content") > 1_000_000
    files = body.select(F.concat(F.lit("bundles/"), "n", F.lit(".json")).alias("path"), content.alias("content"))
    listed = files.select("path", F.when(~large, F.col("content")).alias("content"), F.when(large, "too_large").otherwise("read").alias("status"))
    found = bundles.checked_bundles(listed, max_commands=500)
    return found.select("path", "status", F.size("bundle.commands").cast("bigint").alias("commands"))


POLICY = downloads.DownloadPolicy(("papers.example.org",), max_redirects=3, max_bytes=8_000, max_pages=2)


def _paper_downloads(spark, folder):
    """Web pages as answers of one host, of which some redirect, fail or are no PDF; half the papers ask without https."""
    n = F.col("page_id")
    name = F.concat(F.lit("://papers.example.org/a/"), n, F.lit(".pdf"))
    pages = b.table(spark, folder, "pages").where(n.isNotNull())
    urls = pages.select(F.concat(F.split("url", ":")[0], name).alias("source_url"))
    size = F.octet_length("html").cast("bigint")
    responses = pages.where(n % 31 != 9).select(
        F.concat(F.lit("https"), name).alias("url"),
        F.when((n % 7).isin(1, 3, 4, 5, 6), 302).when(n % 23 == 5, 503).when(n % 23 == 6, 404).otherwise(200).alias("status_code"),
        F.when(n % 37 != 4, F.concat(n + 1, F.lit(".pdf"))).alias("location"),
        F.when(n % 11 == 4, "text/html; charset=utf-8").otherwise("Application/PDF").alias("content_type"),
        F.when(n % 19 == 7, "gzip").alias("content_encoding"),
        F.when(n % 29 == 8, size + 1).otherwise(size).alias("declared_size"),
        size.alias("byte_size"),
        F.encode(F.when(n % 17 == 3, F.col("html")).otherwise(F.concat(F.lit("%PDF-"), "html")), "utf-8").alias("head"),
    )
    return downloads.download_status(urls, responses, POLICY)


def download_status(spark, folder):
    return _paper_downloads(spark, folder)


def paper_status(spark, folder):
    """Downloads with the pages of the document of the same number as what was found inside."""
    n = F.col("doc_id")
    url = F.concat(F.lit("https://papers.example.org/a/"), n, F.lit(".pdf")).alias("url")
    pages = b.document_pages(spark, folder).select(url, "text_chars", "image_count")
    line_count = F.size(F.split("text", "\n"))
    inspections = b.table(spark, folder, "documents").select(
        url, (n % 13 != 5).alias("opened"), (n % 13 == 6).alias("needs_password"), F.ceil(line_count / 30).alias("page_count")
    )
    return downloads.paper_status(_paper_downloads(spark, folder), inspections, pages, POLICY)


_DOWNLOADS_SQL = """
answers AS (SELECT page_id AS n, 'https://papers.example.org/a/' || page_id || '.pdf' AS url,
   CASE WHEN page_id % 7 IN (1, 3, 4, 5, 6) THEN 302 WHEN page_id % 23 = 5 THEN 503 WHEN page_id % 23 = 6 THEN 404 ELSE 200 END AS code,
   CAST(octet_length(encode(html)) AS BIGINT) AS size, html FROM pages WHERE page_id % 31 <> 9),
starts AS (SELECT DISTINCT split_part(url, ':', 1) || '://papers.example.org/a/' || page_id || '.pdf' AS source_url FROM pages),
hops AS (SELECT source_url, source_url AS url, 0 AS hops FROM starts
  UNION ALL SELECT h.source_url, 'https://papers.example.org/a/' || (a.n + 1) || '.pdf', h.hops + 1
  FROM hops h JOIN answers a ON a.url = h.url WHERE a.code = 302 AND a.n % 37 <> 4 AND h.hops < 3),
ends AS (SELECT source_url, arg_max(url, hops) AS url, max(hops) AS hops FROM hops GROUP BY 1),
downloads AS (SELECT e.source_url, e.url, e.hops,
   CASE WHEN NOT starts_with(e.url, 'https://') THEN 'unsafe_pdf_url' WHEN code = 302 THEN 'download_redirect_error'
        WHEN code IS NULL THEN 'no_response' WHEN code = 503 THEN 'download_retryable_http_error' WHEN code = 404 THEN 'download_http_error'
        WHEN n % 11 = 4 THEN 'invalid_content_type' WHEN n % 19 = 7 THEN 'unsupported_content_encoding'
        WHEN size > 8000 OR n % 29 = 8 AND size + 1 > 8000 THEN 'size_limit_exceeded' WHEN n % 29 = 8 THEN 'truncated_response'
        WHEN n % 17 = 3 AND NOT starts_with(html, '%PDF-') THEN 'invalid_pdf_signature' ELSE 'downloaded' END AS status
 FROM ends e LEFT JOIN answers a ON a.url = e.url)"""

PLANS = {
    "batched_lookup": (
        batched_lookup,
        """WITH ids AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL),
batches AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch FROM ids)
SELECT doc_id, lang, source, batch FROM batches JOIN documents USING (doc_id)""",
    ),
    "cursor_listing": (
        cursor_listing,
        "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'signup', 'click', 'error', 'purchase')",
    ),
    "metadata_legs": (
        metadata_legs,
        """WITH taken AS (SELECT DISTINCT l_suppkey, l_shipdate AS newest FROM lineitem WHERE l_returnflag = 'R'),
asked AS (SELECT *, l_shipdate + INTERVAL 9 HOUR AS asked_at FROM lineitem WHERE l_returnflag <> 'R'),
found AS (SELECT a.*, t.newest FROM asked a ASOF LEFT JOIN taken t ON a.l_suppkey = t.l_suppkey AND a.asked_at >= t.newest),
legs AS (SELECT *, CASE WHEN newest::DATE = asked_at::DATE THEN 'same_day' WHEN l_linenumber % 4 = 0 THEN 'api'
   WHEN l_linenumber % 4 = 1 THEN 'failed' WHEN l_quantity < 10 THEN 'feeds'
   WHEN newest >= asked_at - INTERVAL 7 DAY THEN 'stale' ELSE 'failed' END AS leg FROM found)
SELECT l_orderkey, l_linenumber, l_suppkey, asked_at, l_quantity, leg,
  CASE WHEN leg IN ('same_day', 'stale') THEN newest END AS snapshot_at FROM legs""",
    ),
    "download_status": (
        download_status,
        f"WITH RECURSIVE {_DOWNLOADS_SQL} SELECT * FROM downloads",
    ),
    "paper_status": (
        paper_status,
        f"""WITH RECURSIVE {b.ITEMS_SQL}, {_DOWNLOADS_SQL},
sheets AS (SELECT doc_id, pdf_page, sum(CASE WHEN label = 'section_header' THEN 0 ELSE n END) AS chars,
  count(*) FILTER (WHERE label IN ('table', 'picture')) AS images FROM items GROUP BY 1, 2),
layers AS (SELECT doc_id, count(*) AS sheets, count(*) FILTER (WHERE chars = 0) AS bare, bool_or(images > 0) AS images FROM sheets GROUP BY 1),
found AS (SELECT d.source_url, d.url, d.hops, l.sheets, l.bare,
   CASE WHEN status <> 'downloaded' THEN status WHEN l.doc_id IS NULL OR l.doc_id % 13 = 5 THEN 'corrupt'
        WHEN l.doc_id % 13 = 6 THEN 'encrypted' WHEN l.sheets > 2 THEN 'page_limit_exceeded'
        WHEN l.bare = l.sheets AND l.images THEN 'scanned' WHEN l.bare = l.sheets THEN 'no_text' ELSE 'ready' END AS status
 FROM downloads d LEFT JOIN layers l ON d.url = 'https://papers.example.org/a/' || l.doc_id || '.pdf')
SELECT source_url, url, hops, status,
  CASE WHEN status IN ('ready', 'scanned', 'no_text') THEN sheets END AS inspected_pages,
  CASE WHEN status IN ('ready', 'scanned', 'no_text') THEN bare END AS pages_without_text FROM found""",
    ),
    "bundle_scan": (
        bundle_scan,
        """WITH k AS (SELECT event_id // 100 AS n, count(*) AS c, bool_or(json_extract_string(props, '$.k') IS NULL) AS gaps FROM events
  WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1),
s AS (SELECT n, c, CASE WHEN n % 11 = 5 THEN 'too_large' WHEN n % 11 = 2 THEN 'unreadable' WHEN n % 11 = 7 OR gaps THEN 'incomplete'
   WHEN n % 11 = 1 THEN 'digest_mismatch' WHEN n % 11 = 3 AND c > 1 THEN 'not_ordered' WHEN n % 11 = 4 THEN 'repeated_command' ELSE 'accepted' END AS status FROM k)
SELECT 'bundles/' || n || '.json' AS path, status, CASE WHEN status = 'accepted' THEN c END AS commands FROM s""",
    ),
}
