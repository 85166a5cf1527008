import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lectern import sinks
from lectern.functions import models
from lectern.sources import feeds, files, paged, registry

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2401.00001v2</id><title> A  title
 here </title><summary>Text</summary><published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated>
<author><name>Ann B</name></author><author><name>C D</name></author><category term="cs.LG"/><category term="cs.AI"/>
<arxiv:primary_category term="cs.LG"/><link href="http://arxiv.org/pdf/2401.00001v2" title="pdf" type="application/pdf"/></entry>
<entry><id>http://arxiv.org/abs/2401.00001v1</id><title>Old</title><summary>Text</summary><published>2024-01-01T00:00:00Z</published>
<updated>2024-01-01T00:00:00Z</updated><author><name>A</name></author><category term="cs.LG"/></entry>
<entry><id>oai:arXiv.org:2401.00002v1</id><title>T</title><summary>S</summary><published>2024-01-02T00:00:00Z</published>
<updated>2024-01-02T00:00:00Z</updated><author><name>A</name></author><category term="cs.CV"/><arxiv:announce_type>cross</arxiv:announce_type></entry>
<entry><id>http://arxiv.org/abs/nothing</id><title>T</title><summary>S</summary><published>2024-01-02T00:00:00Z</published><updated>2024-01-02T00:00:00Z</updated></entry>
<entry><id>http://arxiv.org/abs/2401.00003v1</id><title>T</title><summary>S</summary><published>someday</published><updated>2024-01-02T00:00:00Z</updated><category term="cs.CV"/></entry>
</feed>"""


def test_atom_entries(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(ATOM)
    entries, rejected = feeds.parse_entries(feeds.read_atom(spark, str(tmp_path / "feed.xml")))
    rows = {(r.arxiv_id, r.version): r for r in entries.collect()}
    assert set(rows) == {("2401.00001", 2), ("2401.00001", 1), ("2401.00002", 1)}
    first = rows[("2401.00001", 2)]
    assert first.title == "A title here" and first.authors == ["Ann B", "C D"]
    assert first.categories == ["cs.AI", "cs.LG"] and first.primary_category == "cs.LG"
    assert first.pdf_url == "http://arxiv.org/pdf/2401.00001v2"
    assert rows[("2401.00001", 1)].pdf_url == "https://arxiv.org/pdf/2401.00001v1"
    assert rejected.count() == 2
    assert {r.title for r in feeds.latest_entries(entries).collect()} == {"A title here", "T"}
    assert feeds.announced(entries, False).count() == 2 and feeds.announced(entries, True).count() == 3
    merged = feeds.category_feeds([entries, entries], ["cs.LG"], False, None).collect()
    assert [r.arxiv_id for r in merged] == ["2401.00001"]


def test_preprints_keep_the_latest_day(spark, tmp_path):
    def paper(doi, date, category):
        return {"title": doi, "authors": "A B; C", "abstract": "x", "doi": doi, "version": "2", "date": date, "category": category}

    body = {"collection": [paper("10/1", "2024-01-01", "biology"), paper("10/2", "2024-01-02", "biology"), paper("10/3", "2024-01-02", "other")],
            "messages": [{"status": "ok"}]}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1))
    row = feeds.read_preprints(spark, str(tmp_path / "p.json"), "biorxiv", ["Biology"]).collect()
    assert [(r.title, r.authors, r.pdf_url) for r in row] == [("10/2", ["A B", "C"], "https://www.biorxiv.org/content/10/2v2.full.pdf")]


def test_paged_source(spark):
    paged.install(spark)
    df = (spark.read.format("paged_listing").schema("id long, name string")
          .option("fetcher", "tests.fetchers:numbers").option("total", "25").option("page_size", "10").load())
    assert df.rdd.getNumPartitions() == 3
    assert [r.id for r in df.orderBy("id").collect()] == list(range(25))


def test_registry_and_fallback(spark):
    assert registry.get("atom") is feeds.read_atom
    with pytest.raises(ValueError, match="not registered"):
        registry.get("nope")

    def down():
        raise registry.SourceUnavailable("down")

    assert registry.first_available([down, lambda: spark.range(3)]).count() == 3
    with pytest.raises(registry.SourceUnavailable):
        registry.first_available([down, down])
    merged = registry.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}})
    assert merged == {"a": {"x": 1, "y": 3}, "b": 1}
    assert registry.without_empty({"a": {"b": None, "c": [""]}, "d": 0}) == {"d": 0}


def _tar(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            archive.addfile(info, io.BytesIO(text.encode()))
    return buffer.getvalue()


def test_tex_archives(spark, tmp_path):
    doc = "\\begin{document}"
    archives = {
        "single.tar": [("only.tex", "x %c\ny")],
        "bbl.tar": [("paper.bbl", ""), ("other.tex", doc), ("paper.tex", "m \\input{sec} \\include{sec2} \\input{sec2}"), ("sec.tex", "S1"), ("sec2.tex", "S2")],
        "title.tar": [("a.tex", doc + " cats"), ("b.tex", doc + " dogs and dogs"), ("example.tex", doc + " dogs dogs dogs")],
        "none.tar": [("a.tex", "x"), ("b.tex", "y")],
        "missing.tar": [("m.tex", doc + " \\input{gone}!")],
    }
    for name, members in archives.items():
        (tmp_path / name).write_bytes(_tar(members))
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    members = files.archive_members(files.read_files(spark, str(tmp_path), "*.tar", 10**6)).cache()
    titles = members.select("path").distinct().withColumn("title", F.lit("About dogs"))
    sources = files.inlined_tex(files.main_tex(members, titles), members)
    got = {r.path.rsplit("/", 1)[1]: (r.name, r.source) for r in sources.collect()}
    assert got == {
        "single.tar": ("only.tex", "x \ny"), "bbl.tar": ("paper.tex", "m S1 \\include{sec2} S2"),
        "title.tar": ("b.tex", doc + " dogs and dogs"), "missing.tar": ("m.tex", doc + " !"),
    }


def test_broken_archives_are_rows(spark, tmp_path):
    whole = _tar([("a.tex", "x" * 5000), ("b.tex", "".join(chr(33 + i * i % 90) for i in range(60_000)))])
    plain = io.BytesIO(gzip.decompress(whole))
    (tmp_path / "gzip.tar").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "plain.tar").write_bytes(plain.getvalue()[:20_000])
    (tmp_path / "whole.tar").write_bytes(whole)
    (tmp_path / "none.tar").write_bytes(b"no archive")
    got = {}
    for r in files.archive_members(files.read_files(spark, str(tmp_path), "*.tar", 10**6)).orderBy("place").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.name or r.failure)
    assert got["whole.tar"] == ["a.tex", "b.tex"] and got["none.tar"] == ["unreadable_archive"]
    assert got["gzip.tar"][-1] == got["plain.tar"][-1] == "truncated_archive"


def test_pdf_checks_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 xx")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 1000)
    found = files.checked_pdfs(files.read_files(spark, str(tmp_path), "*.pdf", 500))
    assert {r.path[-5:]: (r.is_pdf, r.status) for r in found.collect()} == {
        "a.pdf": (True, "read"), "b.pdf": (False, "read"), "c.pdf": (None, "too_large")
    }

    def inspect(content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        return [{"pdf_page": 1, "width": 1.0, "height": 2.0, "text_chars": len(content), "image_count": 0}]

    pages = files.pdf_pages(found, inspect).collect()
    assert sorted((r.path[-5:], r.text_chars, r.failure) for r in pages) == [
        ("a.pdf", 11, None), ("b.pdf", None, "not a PDF"), ("c.pdf", None, "not_read")
    ]


def test_batches_replace_only_their_run(spark, tmp_path):
    path = str(tmp_path / "batches")
    sinks.write_batch(spark.range(3), path, "r1")
    sinks.write_batch(spark.range(4), path, "r2")
    sinks.write_batch(spark.range(1), path, "r1")
    assert sinks.read_batch(spark, path, "r1").count() == 1 and sinks.read_batch(spark, path, "r2").count() == 4
    sinks.write_batch(spark.range(0), path, "r2")
    assert sinks.read_batch(spark, path, "r2").columns == ["id", "run_id"] and sinks.read_batch(spark, path, "r2").count() == 0
    metrics = str(tmp_path / "metrics")
    sinks.write_metrics(spark.range(1), metrics, "r1", "h1")
    sinks.write_metrics(spark.range(2), metrics, "r1", "h1")
    with pytest.raises(ValueError, match="another configuration"):
        sinks.write_metrics(spark.range(2), metrics, "r1", "h2")
    images = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    assert sinks.content_addressed(images).count() == 2


def test_models_run_in_batches(spark):
    encode = models.encoder_column(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    df = spark.createDataFrame([("a",), ("bbb",), ("cc",)], "text string").withColumn("v", encode("text"))
    assert {r.text: r.v for r in df.collect()} == {"a": [1.0, 1.0], "bbb": [3.0, 1.0], "cc": [2.0, 1.0]}
    answer = models.text_model_column(lambda: lambda prompts: [p.upper() for p in prompts])
    assert {r.x for r in df.select(answer("text").alias("x")).collect()} == {"A", "BBB", "CC"}
    known = spark.createDataFrame([("a", [1.0])], "text string, embedding array<double>")
    assert models.from_table(df.where("text = 'a'"), known, "text", "embedding").count() == 1
    with pytest.raises(Exception, match="no stored embedding"):
        models.from_table(df, known, "text", "embedding").collect()


def test_retries():
    from datetime import datetime, timezone

    from lectern.sources import retry

    waits, failures = [], [retry.HttpFailure(429, "7"), retry.HttpFailure(503)]

    def call():
        if failures:
            raise failures.pop(0)
        return "done"

    assert retry.with_retries(call, sleep=waits.append) == "done"
    assert waits == [7.0, 2.0]
    with pytest.raises(retry.HttpFailure):
        retry.with_retries(lambda: (_ for _ in ()).throw(retry.HttpFailure(404)), sleep=waits.append)
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert retry.requested_wait("Mon, 01 Jan 2024 00:00:20 GMT", now, 15.0) == 15.0
    assert retry.requested_wait("nan", now, 15.0) is None and retry.requested_wait("inf", now, 15.0) is None
    assert retry.backoff(3, 2.0, 30.0) == 8.0 and retry.backoff(3, 2.0, 30.0, linear=True) == 6.0
    assert retry.requested_wait("soon", now, 15.0) is None and retry.requested_wait("-3", now, 15.0) == 0.0


def test_environment_values():
    config = {"a": "${oc.env:NAME}", "b": ["x-${oc.env:NONE, y}-${oc.env:NAME}"], "c": "${oc.env:NONE,null}", "d": 3, "e": "${oc.env:EMPTY,z}"}
    got = registry.with_environment(config, {"NAME": "${oc.env:NONE}", "EMPTY": ""})
    assert got == {"a": "${oc.env:NONE}", "b": ["x-y-${oc.env:NONE}"], "c": None, "d": 3, "e": ""}
    with pytest.raises(ValueError, match="'NONE' is not set"):
        registry.with_environment({"a": {"b": "${oc.env:NONE}"}}, {})


def test_library_entries_are_counted(spark):
    entries = [
        '{"key": "K", "data": {"itemType": "preprint", "title": "T", "dateAdded": "2024-01-02T03:04:05Z"}}',
        '{"key": "K", "data": {"itemType": "preprint", "dateAdded": "then"}}', '{"data": {"itemType": "preprint", "dateAdded": "2024-01-02"}}',
        '{"key": "K"}', "{", None, '{"key": "B", "data": {"itemType": "book"}}',
    ]
    items, counts = feeds.library_items(spark.createDataFrame([(e,) for e in entries], "entry string"), "entry")
    assert [(r.key, r.title, r.abstract, r.collection_keys) for r in items.collect()] == [("K", "T", "", [])]
    assert counts.collect() == [(1, 1, 5)]


def test_preprints_without_a_field_are_rejected(spark):
    rows = spark.createDataFrame(
        [("t", "a", "x", "d", "1", "2024-01-02", "bio"), (None, "a", "x", None, "1", "2024-01-02", "bio"), ("t", "a", "x", None, "1", "2024-01-02", "bio"),
         (None, "a", "x", "d", "1", "2024-01-01", "bio"), (None, "a", "x", "d", "1", "2024-01-02", "other")],
        "title string, authors string, abstract string, doi string, version string, date string, category string",
    )
    papers, rejected = feeds.preprint_papers(rows, "server", ["Bio"])
    assert [r.title for r in papers.collect()] == ["t"]
    assert sorted(r.reason for r in rejected.collect()) == ["doi_missing", "title_missing"]
