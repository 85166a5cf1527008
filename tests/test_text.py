import pytest
from pyspark.sql import functions as F

from lectern.functions import fixedpoint, text as t, urls
from lectern.operators import retrieval_pick

GLOBS = [
    ("A/B", "A/**", True), ("A", "A/**", False), ("A/B/C", "A/**", True), ("A/.x", "A/**", False),
    ("A/B", "A/*", True), ("A/B/C", "A/*", False), ("2026/survey", "2026/?urvey", True),
    ("2026/xurvey", "2026/[!s]urvey", True), ("2026/survey", "2026/[!s]urvey", False), ("x/A/y", "**/A/**", True),
    ("A/B", "a/b", False), ("A/B\n", "A/B", False), ("A.b", "A?b", True), ("AxB", "A.B", False),
]


def _one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_globs(spark):
    for path, pattern, expected in GLOBS:
        got = _one(spark, m=t.matches_any(F.lit(path), [pattern]))["m"]
        assert got is expected, (path, pattern)


@pytest.mark.parametrize("raw, expected", [
    ("arXiv:2401.00001v2", "2401.00001"), (" 2401.00001 ", "2401.00001"), ("ARXIV:hep-th/9901001V3", "hep-th/9901001"),
    ("2401.00001v0", None), ("abc", None), ("2401.00001\n", None),
])
def test_feedback_ids(spark, raw, expected):
    assert _one(spark, x=t.feedback_paper_id(F.lit(raw)))["x"] == expected


def test_titles_and_priorities(spark):
    titles = {"3.1 Methods": "methods", "A. Proofs!": "proofs", "A Study": "a study", "B.2) X-ray  view": "x ray view", "10: Results": "results"}
    for raw, expected in titles.items():
        assert _one(spark, x=t.normalized_title(F.lit(raw)))["x"] == expected
    for path, expected in ((["abstract"], 6), (["summary", "abstract"], 6), ([], 5), (["results", "our method"], 1),
                           (["ablation analysis"], 0), (["ablation"], 3), (["supplementary"], 4), (["abstract", "other"], 5)):
        array = F.array(*[F.lit(p) for p in path]).cast("array<string>")
        assert _one(spark, x=t.section_priority(array))["x"] == expected, path


def test_labels_ids_and_runs(spark):
    got = _one(
        spark,
        a=t.visual_label(F.lit("Fig. 3-b: x"), F.lit("figure")), b=t.visual_label(F.lit("TABLE S1 x"), F.lit("table")),
        c=t.visual_label(F.lit("Chart 1"), F.lit("figure")), d=t.version_of_url(F.lit("http://x/abs/2401.00001v12")),
        e=t.version_of_url(F.lit("http://x/abs/2401.00001")), f=t.safe_run_id(F.lit("com1.log")),
        g=t.safe_run_id(F.lit("20240101T000000Z")), h=t.safe_run_id(F.lit("x.")), i=t.safe_run_id(F.lit("a b")),
    )
    assert got == {"a": "Figure 3-b", "b": "Table S1", "c": None, "d": 12, "e": 1, "f": False, "g": True, "h": False, "i": False}


def test_escapes_and_cleaning(spark):
    got = _one(
        spark,
        a=t.escape_markdown(F.lit(" a*b\n<c> 'q' "), "none"), b=t.escape_markdown(F.lit("   "), "none"),
        c=t.collapse(F.lit(" a  \x1c b\n")), d=t.clean_latex(F.lit("a%x\nb\\\\   c\n\n\\iffalse z\\fi")),
        e=t.unfenced(F.lit("```json\n{\"a\": 1}\n```")), f=t.json_list(F.lit('see ["x", "y", "x"] and ["z"]')),
        g=t.tokens(F.lit("Ab-c1 É x")), h=t.main_text(F.lit("<head>h</head><nav>n</nav><p>a&amp;lt;</p><script>s</script><p>b</p>")),
    )
    assert got["a"] == "a\\*b &lt;c\\&gt; &#x27;q&#x27;"
    assert got["b"] == "none" and got["c"] == "a b"
    assert got["d"] == "a\nb c\n"
    assert got["e"] == '{"a": 1}' and got["f"] == ["x", "y"] and got["g"] == ["ab", "c1", "x"]
    assert got["h"] == "a&lt;\nb"


def test_urls(spark):
    hosts = ["arxiv.org"]
    for url, allowed in (("https://arxiv.org/pdf/1", True), ("HTTPS://ARXIV.org:443/x", True), ("https://arxiv.org:8443/x", False),
                         ("https://u@arxiv.org/x", False), ("http://arxiv.org/x", False), ("https://evil.org/arxiv.org", False)):
        assert _one(spark, x=urls.allowed_download(F.lit(url), hosts))["x"] is allowed, url
    got = _one(spark, a=urls.sanitized(F.lit("HTTPS://User:pw@Host.ORG:443/P/x?q=1#f")), b=urls.redacted(F.lit("ht tps://u@h/x")),
               c=urls.display_https(F.lit("https://h/x?y")), d=urls.display_https(F.lit("https://u@h")))
    assert got == {"a": "https://host.org:443/P/x", "b": urls.REDACTED, "c": "https://h/x?y", "d": None}


def test_artifact_paths(spark):
    cases = {
        "index.html": "ok", "papers/readerState.html": "forbidden", "papers/localStorage-x.html": "forbidden",
        "assets/feedback.js": "ok", "assets/other.js": "forbidden", "x.pdf": "forbidden", "data.json": "forbidden",
        "build-manifest.json": "ok", "assets/evidence/a.png": "ok", ".env.local/a.html": "forbidden",
    }
    for path, expected in cases.items():
        declared = F.lit("evidence" not in path)
        got = _one(spark, x=urls.artifact_verdict(F.lit(path), t.path_tokens(F.lit(path)), declared))["x"]
        assert got == expected, path
    got = _one(spark, x=urls.artifact_verdict(F.lit("b.html"), t.path_tokens(F.lit("b.html")), F.lit(False)))["x"]
    assert got == "undeclared"


def test_authors_affiliations_and_stars(spark):
    def array(n):
        return F.array(*[F.lit(f"a{k}") for k in range(n)]).cast("array<string>")

    got = _one(spark, a=t.short_authors(array(5)), b=t.short_authors(array(7)), c=t.short_affiliations(array(6)),
               d=t.short_affiliations(F.lit(None).cast("array<string>")),
               **{f"s{k}": t.half_stars(F.lit(v)) for k, v in enumerate((5.0, 6.0, 6.1, 7.0, 7.9, 8.0))})
    assert got["a"] == "a0, a1, a2, a3, a4" and got["b"] == "a0, a1, a2, ..., a5, a6"
    assert got["c"] == "a0, a1, a2, a3, a4, ..." and got["d"] == "Unknown Affiliation"
    assert [got[f"s{k}"] for k in range(6)] == [0, 0, 1, 5, 10, 10]


def test_fixed_point(spark):
    n = lambda v: F.lit(v)
    got = _one(spark, a=fixedpoint.ppm(n(5), n(6)), b=fixedpoint.ppm(n(2), n(3)), c=fixedpoint.share_ppm(n(1), n(0)),
               d=fixedpoint.improvement_ppm(n(100), n(90)), e=fixedpoint.improvement_ppm(n(3), n(4)),
               f=fixedpoint.token_estimate(F.lit("é☃a")), g=fixedpoint.cost_micro_usd(n(1), n(0), 1, 1))
    assert got == {"a": 833333, "b": 666667, "c": 0, "d": 100000, "e": -333333, "f": 2, "g": 1}
    with pytest.raises(Exception, match="denominator"):
        spark.range(1).select(fixedpoint.ppm(F.lit(1), F.lit(0) * F.col("id").cast("int"))).collect()


def test_bm25_pick(spark):
    texts = spark.createDataFrame(
        [("g", 0, "nothing here"), ("g", 1, "deep vision nets"), ("g", 2, "deep deep vision"), ("h", 4, "b"), ("h", 3, "a"), ("i", 1, "x y"), ("i", 0, "x y")],
        "grp string, k long, body string")
    queries = spark.createDataFrame([("g", "Deep vision"), ("h", "!!"), ("i", "x")], "grp string, q string")
    scores = retrieval_pick.bm25_scores(queries, texts, "grp", "k", "body", "q")
    got = {r.grp: r.k for r in retrieval_pick.bm25_pick(scores, "grp", "k").collect()}
    assert got == {"g": 2, "h": 3, "i": 0}


def test_payload_keys_at_any_depth_and_behind_escapes(spark):
    cases = [
        ('{"status":"a\\\\","evil":1}', False), ('{"status":"a\\\\"}', True), ('{"status":"say \\"evil\\": 1"}', True),
        ('{"status":{"byte_count":[{"status":1},{"evil":2}]}}', False), ('{"status":{"byte-count":[{" STATUS ":1}]}}', True),
        ('{"ev\\"il":1}', False), ('{"status":"' + "x\\\\" * 20_000 + '"}', True), ("[]", True),
    ]
    frame = spark.createDataFrame(cases, "payload string, wanted boolean")
    got = frame.select("payload", "wanted", urls.cache_payload_allowed(F.col("payload")).alias("allowed")).collect()
    assert [r.payload[:60] for r in got if r.allowed != r.wanted] == []
