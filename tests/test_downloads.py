import pytest

from lectern.sources import downloads

POLICY = downloads.DownloadPolicy(("a.org", "B.org"), max_redirects=3, max_bytes=100, max_pages=5)
RESPONSE = (
    "url string, status_code int, location string, content_type string, content_encoding string,"
    "declared_size bigint, byte_size bigint, head binary"
)
GOOD = ("application/pdf; x=1", None, 50, 50, bytearray(b"%PDF-1.7"))


def _responses(spark):
    rows = [("https://a.org/good", 200, None, *GOOD), ("https://b.org/x/last?q=1", 200, None, *GOOD)]
    for k, location in enumerate(["/x/r1", "r2", "//b.org/x/r3", "?q=1"]):
        start = "https://b.org" if k == 3 else "https://a.org"
        rows.append((f"{start}/x/r{k}", 302, location, None, None, None, None, None))
    rows.append(("https://b.org/x/r3?q=1", 200, None, *GOOD))
    for name, change in {
        "busy": (503, *GOOD), "gone": (404, *GOOD), "html": (200, "text/html", *GOOD[1:]), "untyped": (200, None, *GOOD[1:]),
        "zipped": (200, "application/pdf", "gzip", 50, 50, GOOD[4]), "declared": (200, GOOD[0], "", 101, 5, GOOD[4]),
        "large": (200, GOOD[0], " Identity ", None, 101, GOOD[4]), "short": (200, GOOD[0], None, 50, 49, GOOD[4]),
        "fake": (200, GOOD[0], None, 50, 50, bytearray(b"<html")), "empty": (200, GOOD[0], None, None, None, None),
        "unsized": (200, "APPLICATION/octet-stream", None, -1, 100, GOOD[4]),
    }.items():
        rows.append((f"https://a.org/{name}", change[0], None, *change[1:]))
    for name, location in {"loop": "loop", "out": "https://c.org/x", "plain": "http://a.org/good", "nowhere": None, "void": "missing"}.items():
        rows.append((f"https://a.org/{name}", 301, location, None, None, None, None, None))
    return spark.createDataFrame(rows, RESPONSE)


EXPECTED = {
    "https://a.org/good": (0, "downloaded"), "https://a.org/unsized": (0, "downloaded"),
    "https://a.org/x/r1": (3, "downloaded"), "https://a.org/x/r0": (3, "download_redirect_error"),
    "https://a.org/loop": (3, "download_redirect_error"), "https://a.org/nowhere": (0, "download_redirect_error"),
    "https://a.org/out": (1, "unsafe_pdf_url"), "https://a.org/plain": (1, "unsafe_pdf_url"), "http://a.org/good": (0, "unsafe_pdf_url"),
    "https://u:p@a.org/good": (0, "unsafe_pdf_url"), "https://a.org:444/good": (0, "unsafe_pdf_url"), "": (0, "unsafe_pdf_url"),
    None: (0, "unsafe_pdf_url"), "https://a.org/void": (1, "no_response"), "https://a.org/never": (0, "no_response"),
    "https://a.org/busy": (0, "download_retryable_http_error"), "https://a.org/gone": (0, "download_http_error"),
    "https://a.org/html": (0, "invalid_content_type"), "https://a.org/untyped": (0, "invalid_content_type"),
    "https://a.org/zipped": (0, "unsupported_content_encoding"), "https://a.org/declared": (0, "size_limit_exceeded"),
    "https://a.org/large": (0, "size_limit_exceeded"), "https://a.org/short": (0, "truncated_response"),
    "https://a.org/fake": (0, "invalid_pdf_signature"), "https://a.org/empty": (0, "invalid_pdf_signature"),
}


def test_every_status_of_a_download(spark):
    urls = spark.createDataFrame([(u,) for u in [*EXPECTED, "https://a.org/good"]], "source_url string")
    found = downloads.download_status(urls, _responses(spark), POLICY).collect()
    assert {r.source_url: (r.hops, r.status) for r in found} == EXPECTED and len(found) == len(EXPECTED)
    assert {r.url for r in found if r.source_url == "https://a.org/x/r1"} == {"https://b.org/x/r3?q=1"}


@pytest.mark.parametrize("empty", ["urls", "responses"])
def test_empty_tables(spark, empty):
    urls = spark.createDataFrame([("https://a.org/good",)], "source_url string")
    responses = _responses(spark)
    if empty == "urls":
        assert downloads.download_status(urls.where("false"), responses, POLICY).count() == 0
    else:
        assert downloads.download_status(urls, responses.where("false"), POLICY).first().status == "no_response"


def test_every_status_of_an_inspection(spark):
    names = ["corrupt", "absent", "encrypted", "long", "scanned", "no_text", "ready", "no_pages", "gone"]
    found = spark.createDataFrame(
        [(n, n, 0, "download_http_error" if n == "gone" else "downloaded") for n in names],
        "source_url string, url string, hops int, status string",
    )
    inspections = spark.createDataFrame([
        ("corrupt", False, None, None), ("encrypted", True, True, 9), ("long", True, False, 6), ("scanned", True, False, 2),
        ("no_text", True, None, 1), ("ready", True, False, 5), ("no_pages", True, False, 0), ("gone", True, False, 1),
    ], "url string, opened boolean, needs_password boolean, page_count int")
    pages = spark.createDataFrame([
        ("scanned", 0, 1), ("scanned", None, 0), ("no_text", 0, None), ("ready", 3, 1), ("ready", 0, 1), ("long", 0, 0), ("gone", 1, 1),
    ], "url string, text_chars int, image_count int")
    rows = downloads.paper_status(found, inspections, pages, POLICY).collect()
    assert {r.source_url: (r.status, r.inspected_pages, r.pages_without_text) for r in rows} == {
        "corrupt": ("corrupt", None, None), "absent": ("corrupt", None, None), "encrypted": ("encrypted", None, None),
        "long": ("page_limit_exceeded", None, None), "scanned": ("scanned", 2, 2), "no_text": ("no_text", 1, 1),
        "ready": ("ready", 2, 1), "no_pages": ("ready", 0, 0), "gone": ("download_http_error", None, None),
    }
