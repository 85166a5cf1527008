"""One status for every paper that was to be downloaded and inspected.

The crawler writes what it received as rows; whether a paper may be used is decided here,
by joins.  Redirects are followed over a narrow table of links, one join a hop, and only
papers that are still on their way take part in the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.urls import allowed_download, authority, path, scheme

# Statuses that ask for another attempt, those that redirect, and content types of a PDF.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
REDIRECTS = (301, 302, 303, 307, 308)
PDF_TYPES = ("application/pdf", "application/octet-stream", "binary/octet-stream")
SIGNATURE = b"%PDF-"


@dataclass(frozen=True)
class DownloadPolicy:
    """What may be downloaded and parsed; every limit is stated by the caller."""

    hosts: Sequence[str]
    max_redirects: int
    max_bytes: int
    max_pages: int


def resolved(base: Column, location: Column) -> Column:
    """``location`` seen from ``base``: absolute, of another host, from the root, or from the folder.

    Segments of dots are kept as they are; a null location gives null.
    """
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme(base), F.lit(":"), location))
        .when(location.startswith("/"), F.concat(root, location))
        .when(location.startswith("?"), F.concat(root, path(base), location))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), location))
    )


def followed(urls: DataFrame, responses: DataFrame, policy: DownloadPolicy) -> DataFrame:
    """The last URL of each distinct ``source_url``, its ``hops`` and what went wrong on the way.

    ``responses`` has ``url``, unique, with ``status_code`` and ``location``.  ``way`` is null,
    unsafe_pdf_url (at any hop) or download_redirect_error (no location, or more than
    ``max_redirects`` hops, which also ends every loop).
    """
    links = responses.where(F.col("status_code").isin(*REDIRECTS)).select(
        F.col("url").alias("_from"), "location"
    )
    safe = F.coalesce(allowed_download(F.col("url"), list(policy.hosts)), F.lit(False))
    way = urls.select("source_url").distinct().select(
        "source_url", F.col("source_url").alias("url"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("way"), F.lit(True).alias("_moving")
    )
    for hop in range(policy.max_redirects + 1):
        # Papers at rest bring a key that no link has, and each its own, so that they stay spread.
        asked = F.when(F.col("_moving") & safe, F.col("url")).otherwise(F.concat(F.lit(" at rest "), "source_url"))
        met = way.withColumn("_asked", asked).join(links.withColumn("_is_link", F.lit(True)), F.col("_asked") == F.col("_from"), "left")
        redirect = F.coalesce("_is_link", F.lit(False))
        broken = redirect & (F.col("location").isNull() | F.lit(hop == policy.max_redirects))
        onward = redirect & ~broken
        way = met.select(
            "source_url",
            F.when(onward, resolved(F.col("url"), F.col("location"))).otherwise(F.col("url")).alias("url"),
            (F.col("hops") + onward.cast("int")).alias("hops"),
            F.when(F.col("_moving") & ~safe, "unsafe_pdf_url").when(broken, "download_redirect_error").otherwise(F.col("way")).alias("way"),
            onward.alias("_moving"),
        )
    return way.drop("_moving")


def download_status(urls: DataFrame, responses: DataFrame, policy: DownloadPolicy) -> DataFrame:
    """One row per distinct ``source_url``: the final ``url``, ``hops`` and ``status``.

    ``responses`` has ``url``, ``status_code``, ``location``, ``content_type``,
    ``content_encoding``, ``declared_size``, ``byte_size`` and ``head``, the first bytes of the
    body.  The first rule a paper breaks is its status: unsafe_pdf_url,
    download_redirect_error, no_response, download_retryable_http_error,
    download_http_error, invalid_content_type, unsupported_content_encoding,
    size_limit_exceeded, truncated_response, invalid_pdf_signature, else downloaded.
    A declared size that is no number of bytes counts as not declared.
    """
    final = followed(urls, responses, policy)
    code = F.col("status_code")
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";", 2)[0]))
    encoding = F.lower(F.trim(F.coalesce("content_encoding", F.lit("identity"))))
    declared = F.when(F.col("declared_size") >= 0, F.col("declared_size"))
    received = F.coalesce("byte_size", F.lit(0))
    status = (
        F.when(F.col("way").isNotNull(), F.col("way"))
        .when(code.isNull(), "no_response")
        .when(code.isin(*RETRYABLE), "download_retryable_http_error")
        .when(code >= 400, "download_http_error")
        .when(~kind.isin(*PDF_TYPES), "invalid_content_type")
        .when(~encoding.isin("", "identity"), "unsupported_content_encoding")
        .when(F.coalesce(declared > policy.max_bytes, F.lit(False)) | (received > policy.max_bytes), "size_limit_exceeded")
        .when(F.coalesce(declared != received, F.lit(False)), "truncated_response")
        .when(~F.coalesce(F.substring("head", 1, 5) == F.lit(SIGNATURE), F.lit(False)), "invalid_pdf_signature")
        .otherwise("downloaded")
    )
    # Each response is reached by any number of papers; AQE splits a page that many lead to.
    facts = responses.drop("location").withColumnRenamed("url", "_url")
    return final.join(facts, F.col("url") == F.col("_url"), "left").select("source_url", "url", "hops", status.alias("status"))


def paper_status(downloads: DataFrame, inspections: DataFrame, pages: DataFrame, policy: DownloadPolicy) -> DataFrame:
    """``downloads`` with a final status and page counts: what the inspection found in place of downloaded.

    ``inspections`` has ``url``, unique, with ``opened``, ``needs_password`` and ``page_count``;
    ``pages`` has ``url``, ``text_chars`` and ``image_count``.  A paper is corrupt (not opened,
    or not inspected at all), encrypted, page_limit_exceeded, scanned, no_text or ready; pages
    of papers with an earlier status are not counted.  A paper with no pages is ready, with
    zero pages.
    """
    absent = F.coalesce("text_chars", F.lit(0)) == 0
    layers = pages.groupBy("url").agg(
        F.count_if(absent).alias("pages_without_text"),
        F.count("*").alias("_pages"),
        F.coalesce(F.bool_or(F.col("image_count") > 0), F.lit(False)).alias("_images"),
    )
    opened = F.coalesce("opened", F.lit(False))
    bare = F.col("_pages") == F.col("pages_without_text")
    status = (
        F.when(F.col("status") != "downloaded", F.col("status"))
        .when(~opened, "corrupt")
        .when(F.coalesce("needs_password", F.lit(False)), "encrypted")
        .when(F.col("page_count") > policy.max_pages, "page_limit_exceeded")
        .when(bare & F.col("_images"), "scanned")
        .when(bare, "no_text")
        .otherwise("ready")
    )
    readable = F.col("status").isin("ready", "scanned", "no_text")
    joined = downloads.join(inspections, "url", "left").join(layers, "url", "left")
    return joined.withColumn("status", status).select(
        "source_url", "url", "hops", "status",
        F.when(readable, F.coalesce("_pages", F.lit(0))).cast("bigint").alias("inspected_pages"),
        F.when(readable, F.coalesce("pages_without_text", F.lit(0))).cast("bigint").alias("pages_without_text"),
    )
