"""Binary papers: checked downloads, PDF pages and LaTeX archives."""

from __future__ import annotations

import io
import lzma
import tarfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lectern.functions.text import clean_latex
from lectern.operators.retrieval_pick import bm25_pick, bm25_scores
from lectern.schemas import PAGE_ROW

# Names that mark a LaTeX file as a demonstration.
DEMO_NAMES = ("example", "sample", "template")


def read_files(spark: SparkSession, folder: str, pattern: str, max_bytes: int) -> DataFrame:
    """Every file with a ``status``: read, or too_large without its content, which is then not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    small = files.where(F.col("length") <= max_bytes).withColumn("status", F.lit("read"))
    large = files.where(F.col("length") > max_bytes).drop("content").select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("status")
    )
    return small.unionByName(large)


def checked_pdfs(files: DataFrame) -> DataFrame:
    """Add the content address and whether the bytes start like a PDF; files that were not read keep their row."""
    return files.select(
        "path", "length", "content", "status",
        F.sha2("content", 256).alias("sha256"),
        (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"),
    )


def pdf_pages(files: DataFrame, inspect: Callable[[bytes], list[dict]]) -> DataFrame:
    """Page rows from a PDF library of the caller's choice.

    A file without content or that the library rejects gives one row whose ``failure``
    says why and whose page columns are null.
    """
    schema = T.StructType([*PAGE_ROW.fields, T.StructField("failure", T.StringType())])

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"failure": "not_read"}] if content is None else inspect(bytes(content))
                except ValueError as error:
                    rows = [{"failure": str(error) or "corrupt"}]
                frame = pd.DataFrame([{"path": path, **row} for row in rows], columns=schema.fieldNames())
                yield frame.astype(object).where(frame.notna(), None)

    return files.select("path", "content").mapInPandas(pages, schema)


def per_file(files: DataFrame, read: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Rows from a library of the caller's choice: layout items, Markdown text or cropped regions.

    ``schema`` names the columns of ``read`` and ``path``.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield read(bytes(content)).assign(path=path)

    return files.select("path", "content").mapInPandas(rows, schema)


MEMBER = "path string, place long, name string, content string, failure string"


def archive_members(files: DataFrame) -> DataFrame:
    """TeX and bibliography members of tar archives, in archive order.

    What is no archive gives one row with a ``failure`` and nothing else; so does an archive
    that breaks off, after the members before the break.
    """

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        place = 0
        try:
            # One member at a time, however large the archive is when unpacked.
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                for place, member in enumerate(archive):
                    if member.isfile() and member.name.endswith((".tex", ".bbl")):
                        text = archive.extractfile(member).read().decode("utf-8", errors="ignore")
                        yield path, place, member.name, text, None
        except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError) as error:
            yield path, place + 1, None, None, "unreadable_archive" if isinstance(error, tarfile.ReadError) and not place else "truncated_archive"

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows(path, bytes(content)):
                    yield pd.DataFrame([row], columns=["path", "place", "name", "content", "failure"])

    return files.where("content IS NOT NULL").select("path", "content").mapInPandas(members, MEMBER)


def _opens_document(content: Column, name: Column) -> Column:
    demo = F.lit(False)
    for word in DEMO_NAMES:
        demo = demo | name.contains(word)
    return content.contains("\\begin{document}") & ~demo


def main_tex(members: DataFrame, titles: DataFrame) -> DataFrame:
    """The main file of each archive.

    The bibliography names it if there is exactly one; a single TeX file is it;
    otherwise the files that open a document compete, by title where one is known.
    """
    tex = members.where(F.col("name").endswith(".tex")).withColumn("content", clean_latex(F.col("content")))
    bibliography = members.where(F.col("name").endswith(".bbl")).groupBy("path").agg(
        F.count("*").alias("bbl_count"),
        F.concat(F.regexp_replace(F.min("name"), r"\.bbl", ""), F.lit(".tex")).alias("bbl_main"),
    )
    counts = tex.groupBy("path").agg(F.count("*").alias("tex_count"))
    facts = tex.join(counts, "path").join(bibliography, "path", "left")
    by_rule = facts.where(
        (F.col("bbl_count").isNull() & (F.col("tex_count") == 1))
        | ((F.col("bbl_count") == 1) & (F.col("name") == F.col("bbl_main")))
    ).select("path", "place")
    rivals = tex.where(_opens_document(F.col("content"), F.col("name"))).join(by_rule.select("path"), "path", "left_anti")
    asked = rivals.select("path").distinct().join(titles, "path", "left").withColumn(
        "title", F.coalesce("title", F.lit(""))
    )
    picked = bm25_pick(bm25_scores(asked, rivals, "path", "place", "content", "title"), "path", "place")
    chosen = by_rule.unionByName(picked.select("path", "place"))
    return tex.join(chosen, ["path", "place"])


def inlined_tex(main: DataFrame, members: DataFrame) -> DataFrame:
    """Main files with every ``\\input`` replaced by that file's text, or by nothing where it is missing."""
    named = F.concat(
        F.regexp_extract_all("content", F.lit(r"\\input\{(.+?)\}"), 1),
        F.regexp_extract_all("content", F.lit(r"\\include\{(.+?)\}"), 1),
    )
    refs = main.select("path", F.posexplode(named).alias("nth", "ref")).withColumn(
        "name", F.when(F.col("ref").endswith(".tex"), F.col("ref")).otherwise(F.concat("ref", F.lit(".tex")))
    )
    parts = members.where(F.col("name").endswith(".tex")).select(
        "path", "name", clean_latex(F.col("content")).alias("part")
    )
    # A file includes a bounded number of others.
    replacements = refs.join(parts, ["path", "name"], "left").groupBy("path").agg(
        F.array_sort(
            F.collect_list(F.struct("nth", "ref", F.coalesce("part", F.lit("")).alias("part")))
        ).alias("parts")
    )
    joined = main.join(replacements, "path", "left")
    inlined = F.aggregate(
        F.coalesce("parts", F.array().cast("array<struct<nth:int,ref:string,part:string>>")),
        F.col("content"),
        lambda text, r: F.replace(text, F.concat(F.lit("\\input{"), r["ref"], F.lit("}")), r["part"]),
    )
    return joined.select("path", "name", inlined.alias("source"))
