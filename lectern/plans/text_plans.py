"""Text, URL and presentation queries over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t, urls
from lectern.functions.fixedpoint import cost_micro_usd, token_estimate
from lectern.operators import feedback, reader, retrieval_pick
from lectern.operators.quality import profile_exclusion as profile_exclusion_code
from lectern.plans import bindings as b
from lectern.plans.bindings import rounded

_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
INCLUDE, EXCLUDE = ["en/**", "fr/*", "[!ef]?/[0-4]*"], ["**/*.html", "en/4*/**", "*/??"]
HOSTS = ["therin.example.net", "blog.tionsh.example.net", "thther.example.org"]


def _paths(spark, folder):
    return b.spread(b.table(spark, folder, "pages")).select(
        "page_id", F.regexp_replace(urls.path(F.col("url")), "^/|/$", "").alias("path")
    )


_PATHS_SQL = r"""
paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1),
                 '^/|/$', '', 'g') AS path FROM pages)"""


def glob_include_exclude(spark, folder):
    path = F.col("path")
    included, excluded = t.matches_any(path, INCLUDE), t.matches_any(path, EXCLUDE)
    verdict = F.when(path == "", "invalid").when(included & ~excluded, "eligible").otherwise("excluded")
    return _paths(spark, folder).select("page_id", "path", verdict.alias("verdict"))


def glob_accounting(spark, folder):
    return glob_include_exclude(spark, folder).groupBy("verdict").agg(F.count("*").alias("n"))


def item_validity(spark, folder):
    docs = b.documents(spark, folder)
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    valid = t.not_blank(title) & t.not_blank(F.col("text")) & t.not_blank(F.col("source"))
    return docs.groupBy("source").agg(
        F.count_if(valid).alias("valid_count"), F.count_if(~valid).alias("invalid_count")
    )


def whitespace_collapse(spark, folder):
    return b.documents(spark, folder).select(
        "doc_id", F.md5(t.collapse(F.col("text"))).alias("digest")
    )


def ranking_text(spark, folder):
    from lectern.operators.ranking import ranking_text as joined

    docs = b.documents(spark, folder).select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text"
    )
    return docs.select("doc_id", F.md5(joined(F.col("title"), F.col("text"))).alias("digest"))


def section_titles(spark, folder):
    title = t.normalized_title(
        F.concat(F.element_at(F.array(*[F.lit(p) for p in ("", "3.1 ", "A. ", "B.2) ")]),
                              (F.col("pos") % 4 + 1).cast("int")), F.col("line"))
    )
    return b.lines(spark, folder).select(F.md5(title).alias("title_digest")).groupBy("title_digest").agg(
        F.count("*").alias("n")
    )


def section_priorities(spark, folder):
    word = F.element_at(
        F.array(*[F.lit(w) for w in (
            "Introduction", "Our Method", "Results", "Ablation study", "Appendix", "Abstract", "Related work")]),
        (F.col("pos") % 7 + 1).cast("int"),
    )
    top = F.when(F.col("doc_id") % 2 == 0, F.lit("1. Summary")).otherwise(F.lit("2 Background"))
    titles = F.array(t.normalized_title(top), t.normalized_title(F.concat_ws(" ", word, F.col("lang"))))
    plain = F.array(t.normalized_title(top), t.normalized_title(word))
    marked = b.lines(spark, folder).select(
        "doc_id",
        t.section_priority(F.when(F.col("pos") % 3 == 0, titles).otherwise(plain)).alias("priority"),
        t.abstract_only(plain).alias("abstract_only"),
    )
    return marked.groupBy("doc_id", F.col("priority").cast("bigint").alias("priority")).agg(
        F.count("*").alias("n"), F.count_if("abstract_only").alias("abstract_only_count")
    )


def caption_labels(spark, folder):
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("Figure ", "fig. ", "  TABLE ", "Fig ", "Chart ")]),
        (F.col("pos") % 5 + 1).cast("int"),
    )
    caption = F.concat(prefix, F.length("line").cast("string"), F.lit("-b: "), F.col("line"))
    kind = F.when(F.col("pos") % 5 == 2, "table").otherwise("figure")
    labelled = b.lines(spark, folder).select("doc_id", "pos", t.visual_label(caption, kind).alias("label"))
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def paper_ids(spark, folder):
    raw = F.concat(
        F.element_at(F.array(F.lit("arXiv:"), F.lit(""), F.lit("ARXIV:"), F.lit("x")), (F.col("l_linenumber") % 4 + 1)),
        F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0"), F.lit("."),
        F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("V"), F.col("l_linenumber").cast("string"))).otherwise(""),
    )
    ids = b.spread(b.table(spark, folder, "lineitem")).select(raw.alias("raw"))
    return ids.select(
        t.feedback_paper_id(F.col("raw")).alias("paper_id"),
        t.paper_id_of_url(F.concat(F.lit("http://host/abs/"), F.lower("raw"))).alias("url_id"),
        t.version_of_url(F.lower("raw")).cast("bigint").alias("version"),
    ).groupBy("paper_id", "url_id", "version").agg(F.count("*").alias("n"))


_IDS_SQL = r"""
ids AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'arXiv:' WHEN 1 THEN '' WHEN 2 THEN 'ARXIV:' ELSE 'x' END
    || lpad((l_suppkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((l_partkey % 100000)::VARCHAR, 5, '0')
    || CASE WHEN l_linenumber > 2 THEN 'V' || l_linenumber ELSE '' END AS raw FROM lineitem)"""


def token_estimates(spark, folder):
    docs = b.documents(spark, folder).select("lang", token_estimate(F.col("text")).alias("tokens"))
    totals = docs.groupBy("lang").agg(F.sum("tokens").alias("input_tokens"), F.count("*").alias("calls"))
    return totals.withColumn(
        "cost_micro_usd", cost_micro_usd(F.col("input_tokens"), F.col("calls") * 512, 140_000, 280_000)
    )


def html_escape(spark, folder):
    return b.spread(b.table(spark, folder, "pages")).select(
        "page_id", F.md5(t.escape_html(F.col("html"))).alias("digest")
    )


def markdown_escape(spark, folder):
    return b.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.md5(t.escape_markdown(F.col("text"), "not stated")).alias("digest")
    )


def html_main_text(spark, folder):
    text = t.main_text(F.col("html"))
    return b.spread(b.table(spark, folder, "pages")).select(
        "page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest")
    )


def url_policy(spark, folder):
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "://", "://user@")).when(
        F.col("page_id") % 5 == 1, F.regexp_replace("url", "(://[^/]+)", "$1:8443")
    ).otherwise(F.col("url"))
    pages = b.spread(b.table(spark, folder, "pages")).withColumn("raw", url)
    raw = F.col("raw")
    return pages.select(
        "page_id",
        urls.sanitized(raw).alias("safe_url"),
        urls.allowed_download(raw, HOSTS).alias("download_allowed"),
        urls.display_https(raw).alias("display_url"),
        urls.redacted(raw).alias("log_url"),
    )


def latex_clean(spark, folder):
    noisy = F.concat(
        F.replace("text", F.lit(". "), F.lit(" %note\n")),
        F.lit("\\begin{comment}x\ny\\end{comment}\n\n\\iffalse a\n\\fi end\\\\   \tz"),
    )
    return b.documents(spark, folder).select(
        "doc_id", F.md5(t.clean_latex(noisy)).alias("digest")
    )


def truncated_text(spark, folder):
    return b.documents(spark, folder).select(
        "doc_id", F.md5(F.substring("text", 1, 2000)).alias("digest"),
        F.length(F.substring("text", 1, 2000)).cast("bigint").alias("kept"),
    )


def token_counts(spark, folder):
    docs = b.documents(spark, folder).select("doc_id", t.tokens(F.col("text")).alias("words"))
    words = F.col("words")
    return docs.select(
        "doc_id", F.size(words).cast("bigint").alias("tokens"),
        F.size(F.array_distinct(words)).cast("bigint").alias("distinct_tokens"),
        F.md5(F.array_join(F.array_sort(F.array_distinct(words)), " ")).alias("canonical_digest"),
    )


def artifact_paths(spark, folder):
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".html", ".json", ".pdf", "/readerState.html", "/assets/cache/a.png", ".svg")]),
        (F.col("page_id") % 6 + 1).cast("int"),
    )
    paths = _paths(spark, folder).select("page_id", F.concat(F.regexp_replace("path", r"\.html$", ""), suffix).alias("path"))
    verdict = urls.artifact_verdict(F.col("path"), t.path_tokens(F.col("path")), F.col("page_id") % 4 != 0)
    return paths.select("page_id", "path", verdict.alias("verdict"))


def run_ids(spark, folder):
    events = b.table(spark, folder, "events")
    made = t.run_id_of(F.col("ts"))
    odd = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("COM1."), made)).when(
        F.col("event_id") % 7 == 1, F.concat(made, F.lit("."))
    ).otherwise(made)
    return events.select("event_id", odd.alias("run_id")).select(
        "event_id", "run_id", t.safe_run_id(F.col("run_id")).alias("safe"),
        t.is_date_label(F.substring("run_id", 1, 10)).alias("date_label"),
    )


def payload_keys(spark, folder):
    # Every third payload carries other keys, in turn plain, nested, and behind an escaped backslash.
    inner = F.to_json(F.struct(F.concat("event_type", F.lit("\\")).alias("status"), F.col("event_id").alias("byte_count")))
    hidden = F.concat(F.lit('{"status":"\\\\","byte_count":[{"status":'), F.col("props"), F.lit("}]}"))
    payload = F.when(F.col("event_id") % 6 == 0, F.col("props")).when(F.col("event_id") % 3 == 0, hidden).otherwise(inner)
    checked = b.table(spark, folder, "events").select(
        "event_type", urls.cache_payload_allowed(payload).alias("allowed")
    )
    return checked.groupBy("event_type").agg(F.count_if("allowed").alias("allowed_count"), F.count("*").alias("n"))


def affiliations(spark, folder):
    listed = F.to_json(F.slice(F.split(F.col("text"), " "), 1, 9))
    answer = F.concat(F.lit("Found: "), listed, F.lit(" as requested [1]"))
    names = t.json_list(answer)
    return b.table(spark, folder, "benchmark").select(
        "item_id", F.array_join(names, "|").alias("names"), t.short_affiliations(names).alias("shown")
    )


def authors(spark, folder):
    listed = F.transform(
        F.split(F.regexp_replace("text", "[,.] ", " ; "), ";"), lambda a: t.collapse(a)
    )
    return b.table(spark, folder, "benchmark").select(
        "item_id", F.size(listed).cast("bigint").alias("author_count"), t.short_authors(listed).alias("authors")
    )


def star_buckets(spark, folder):
    score = (F.col("c_acctbal") + 1000) / 1100.0
    rated = b.table(spark, folder, "customer").select(t.half_stars(score).alias("half_stars"))
    return rated.groupBy("half_stars").agg(F.count("*").alias("n"))


def reader_search(spark, folder):
    state = feedback.replay(b.commands(spark, folder))
    cards = b.documents(spark, folder).select(
        F.col("doc_id").alias("paper_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")
    )
    searched = F.concat_ws(" ", F.col("paper_id").cast("string"), "title")
    shown = reader.visible(searched, "the", unread_only=True)
    return reader.with_state(cards, state).where(shown).select("paper_id", "title")


def full_text_fallback(spark, folder):
    docs = b.documents(spark, folder).select("doc_id", "text")
    pages = b.spread(b.table(spark, folder, "pages")).select(
        F.col("page_id").alias("doc_id"), t.main_text(F.col("html")).alias("html_text")
    )
    items = b.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("tar_text")
    )
    joined = docs.join(items, "doc_id", "left").join(pages, "doc_id", "left")
    return joined.select("doc_id", F.md5(t.full_text(F.col("tar_text"), F.col("html_text"), F.col("text"))).alias("digest"))


def bm25_pick(spark, folder):
    turns = b.spread(b.table(spark, folder, "conversations"))
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    scores = retrieval_pick.bm25_scores(first, answers, "conv_id", "turn", "text", "query")
    return retrieval_pick.bm25_pick(scores, "conv_id", "turn").select(
        "conv_id", "turn", rounded("score").alias("score")
    )


def profile_exclusion(spark, folder):
    name = F.when(F.col("event_type") == "error", "<lambda>").when(F.col("event_type") == "signup", "audit").otherwise("observe")
    path = F.when(F.col("user_id") % 3 == 0, "daily.py").when(F.col("user_id") % 3 == 1, "artifacts.py").otherwise("collector.py")
    rows = b.table(spark, folder, "events").select(name.alias("function_name"), path.alias("relative_path"))
    rules = {
        "inclusive_wrapper": [("daily.py", None), ("collector.py", "observe")],
        "security_invariant": [("artifacts.py", "audit")],
    }
    code = profile_exclusion_code(F.col("relative_path"), F.col("function_name"), rules)
    return rows.groupBy(code.alias("exclusion_code")).agg(F.count("*").alias("n"))


_TITLE = "trim(regexp_replace(lower(regexp_replace({x}, '" + t.SECTION_NUMBER + "', '')), '[^a-z]+', ' ', 'g'))"


def _main_text_sql(html: str) -> str:
    x = rf"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("head", "script", "style", "nav", "header", "footer", "aside", "form", "table"):
        x = rf"regexp_replace({x}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    x = rf"""regexp_replace({x}, '(?is)<div class="ad">.*?</div>', ' ', 'g')"""
    x = rf"regexp_replace({x}, '(?i)<(?:/p|/h[1-6]|/li|/div|br)[^>]*>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


_MAIN_TEXT = _main_text_sql("html")
_HTML_ESCAPE = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

PLANS = {
    "glob_include_exclude": (
        glob_include_exclude,
        rf"""WITH {_PATHS_SQL}, m AS (SELECT *,
   (regexp_matches(path, '^en/(?:[^.\n/][^/]*/)*(?:[^.\n/][^/]*)?$') OR regexp_matches(path, '^fr/[^./][^/]*$')
    OR regexp_matches(path, '^[^ef./][^./]/[0-4][^/]*$') OR regexp_matches(path, '^[^ef./][^/]/[0-4][^/]*$')) AS inc,
   (regexp_matches(path, '^(?:[^./][^/]*/)*[^./][^/]*\.html$') OR regexp_matches(path, '^en/4[^/]*/(?:[^./][^/]*/)*(?:[^./][^/]*)?$')
    OR regexp_matches(path, '^[^./][^/]*/[^./][^/]$')) AS exc FROM paths)
SELECT page_id, path, CASE WHEN path = '' THEN 'invalid' WHEN inc AND NOT exc THEN 'eligible' ELSE 'excluded' END AS verdict FROM m""",
    ),
    "glob_accounting": (
        glob_accounting,
        rf"""WITH {_PATHS_SQL}, m AS (SELECT *,
   (regexp_matches(path, '^en/(?:[^.\n/][^/]*/)*(?:[^.\n/][^/]*)?$') OR regexp_matches(path, '^fr/[^./][^/]*$')
    OR regexp_matches(path, '^[^ef./][^/]/[0-4][^/]*$')) AS inc,
   (regexp_matches(path, '^(?:[^./][^/]*/)*[^./][^/]*\.html$') OR regexp_matches(path, '^en/4[^/]*/(?:[^./][^/]*/)*(?:[^./][^/]*)?$')
    OR regexp_matches(path, '^[^./][^/]*/[^./][^/]$')) AS exc FROM paths)
SELECT CASE WHEN path = '' THEN 'invalid' WHEN inc AND NOT exc THEN 'eligible' ELSE 'excluded' END AS verdict, count(*) AS n
FROM m GROUP BY ALL""",
    ),
    "item_validity": (
        item_validity,
        rf"""WITH v AS (SELECT source, regexp_replace(split_part(text, chr(10), 1), '{_SPACES}', '', 'g') <> ''
    AND regexp_replace(source, '{_SPACES}', '', 'g') <> '' AS ok FROM documents)
SELECT source, count(*) FILTER (WHERE ok) AS valid_count, count(*) FILTER (WHERE NOT ok) AS invalid_count FROM v GROUP BY source""",
    ),
    "whitespace_collapse": (
        whitespace_collapse,
        rf"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))) AS digest FROM documents",
    ),
    "ranking_text": (
        ranking_text,
        "SELECT doc_id, md5(split_part(text, chr(10), 1) || chr(10) || chr(10) || text) AS digest FROM documents",
    ),
    "section_titles": (
        section_titles,
        f"""WITH {b.LINES_SQL} SELECT md5({_TITLE.format(x="CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN '3.1 ' WHEN 2 THEN 'A. ' ELSE 'B.2) ' END || line")}) AS title_digest,
       count(*) AS n FROM lines GROUP BY 1""",
    ),
    "section_priorities": (
        section_priorities,
        f"""WITH {b.LINES_SQL},
w AS (SELECT *, ['Introduction', 'Our Method', 'Results', 'Ablation study', 'Appendix', 'Abstract', 'Related work'][pos % 7 + 1] AS word,
        CASE WHEN doc_id % 2 = 0 THEN '1. Summary' ELSE '2 Background' END AS top FROM lines),
n AS (SELECT doc_id, pos, {_TITLE.format(x="top")} AS a, {_TITLE.format(x="CASE WHEN pos % 3 = 0 THEN word || ' ' || lang ELSE word END")} AS c,
        {_TITLE.format(x="word")} AS p FROM w),
r AS (SELECT doc_id, CASE
  WHEN regexp_matches(a || '|' || c, 'introduction|motivation|observation|analysis') THEN 0
  WHEN regexp_matches(a || '|' || c, 'method|approach|framework|algorithm') THEN 1
  WHEN regexp_matches(a || '|' || c, 'experiment|result|evaluation') THEN 2
  WHEN regexp_matches(a || '|' || c, 'ablation') THEN 3
  WHEN regexp_matches(a || '|' || c, 'appendix|supplement') THEN 4
  WHEN a IN ('abstract', 'summary') AND c IN ('abstract', 'summary') THEN 6 ELSE 5 END AS priority,
  a IN ('abstract', 'summary') AND p IN ('abstract', 'summary') AS ab FROM n)
SELECT doc_id, CAST(priority AS BIGINT) AS priority, count(*) AS n, count(*) FILTER (WHERE ab) AS abstract_only_count
FROM r GROUP BY doc_id, priority""",
    ),
    "caption_labels": (
        caption_labels,
        rf"""WITH {b.LINES_SQL},
c AS (SELECT pos, ['Figure ', 'fig. ', '  TABLE ', 'Fig ', 'Chart '][pos % 5 + 1] || length(line) || '-b: ' || line AS caption FROM lines),
x AS (SELECT pos, regexp_extract(caption, '(?i)^\s*(?:fig(?:ure)?\.?|table)\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)', 1) AS num FROM c)
SELECT CASE WHEN num <> '' THEN CASE WHEN pos % 5 = 2 THEN 'Table ' ELSE 'Figure ' END || num END AS label, count(*) AS n FROM x GROUP BY 1""",
    ),
    "paper_ids": (
        paper_ids,
        rf"""WITH {_IDS_SQL},
p AS (SELECT raw, regexp_replace(trim(raw), '(?i)^arxiv:', '') AS bare FROM ids)
SELECT CASE WHEN regexp_matches(bare, '(?i)^(?:[a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}}|\d{{4}}\.\d{{4,5}})(?:v[1-9]\d*)?$')
         THEN lower(regexp_replace(bare, '(?i)v[1-9]\d*$', '')) END AS paper_id,
  nullif(regexp_extract('http://host/abs/' || lower(raw), '(?i)((?:[a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}}|\d{{4}}\.\d{{4,5}}))(?:v(\d+))?$', 1), '') AS url_id,
  CAST(coalesce(TRY_CAST(nullif(regexp_extract(lower(raw), '(?i)((?:[a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}}|\d{{4}}\.\d{{4,5}}))(?:v(\d+))?$', 2), '') AS INT), 1) AS BIGINT) AS version,
  count(*) AS n FROM p GROUP BY 1, 2, 3""",
    ),
    "token_estimates": (
        token_estimates,
        """WITH d AS (SELECT lang, CAST(sum((octet_length(encode(text)) + 3) // 4) AS BIGINT) AS input_tokens, count(*) AS calls FROM documents GROUP BY lang)
SELECT lang, input_tokens, calls, CAST((input_tokens * 140000 + calls * 512 * 280000 + 999999) // 1000000 AS BIGINT) AS cost_micro_usd FROM d""",
    ),
    "html_escape": (
        html_escape,
        f"SELECT page_id, md5({_HTML_ESCAPE.format(x='html')}) AS digest FROM pages",
    ),
    "markdown_escape": (
        markdown_escape,
        rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS one FROM conversations),
e AS (SELECT conv_id, turn, one, regexp_replace(one, '([\\`*_{{}}\[\]()#+\-.!|>~])', '\\\1', 'g') AS x FROM c)
SELECT conv_id, turn, md5(CASE WHEN one = '' THEN 'not stated' ELSE {_HTML_ESCAPE.format(x='x')} END) AS digest FROM e""",
    ),
    "html_main_text": (
        html_main_text,
        f"WITH m AS (SELECT page_id, {_MAIN_TEXT} AS x FROM pages) SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM m",
    ),
    "url_policy": (
        url_policy,
        r"""WITH r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://user@')
    WHEN 1 THEN regexp_replace(url, '(://[^/]+)', '\1:8443') ELSE url END AS raw FROM pages),
p AS (SELECT *, lower(split_part(raw, '://', 1)) AS scheme, regexp_extract(raw, '://([^/?#]*)', 1) AS auth,
        regexp_extract(raw, '://[^/?#]*([^?#]*)', 1) AS path FROM r),
h AS (SELECT *, lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':\d*$', '')) AS host,
        nullif(regexp_extract(auth, ':(\d+)$', 1), '') AS port FROM p)
SELECT page_id, scheme || '://' || host || coalesce(':' || port, '') || path AS safe_url,
  scheme = 'https' AND host IN ('therin.example.net', 'blog.tionsh.example.net', 'thther.example.org')
    AND NOT contains(auth, '@') AND coalesce(port = '443', true) AS download_allowed,
  CASE WHEN scheme = 'https' AND NOT contains(auth, '@') THEN raw END AS display_url,
  CASE WHEN contains(auth, '@') THEN 'https://redacted.invalid/credential-url-rejected' ELSE raw END AS log_url FROM h""",
    ),
    "latex_clean": (
        latex_clean,
        r"""WITH n AS (SELECT doc_id, replace(text, '. ', ' %note' || chr(10)) ||
   '\begin{comment}x' || chr(10) || 'y\end{comment}' || chr(10) || chr(10) || '\iffalse a' || chr(10) || '\fi end\\   ' || chr(9) || 'z' AS s FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
  '%[^\n]*\n', chr(10), 'g'), '(?s)\\begin\{comment\}.*?\\end\{comment\}', '', 'g'), '(?s)\\iffalse.*?\\fi', '', 'g'),
  '\n+', chr(10), 'g'), '\\\\', '', 'g'), '[ \t\r\f]{3,}', ' ', 'g')) AS digest FROM n""",
    ),
    "truncated_text": (
        truncated_text,
        "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, length(substr(text, 1, 2000)) AS kept FROM documents",
    ),
    "token_counts": (
        token_counts,
        """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_tokens,
       md5(coalesce(array_to_string(list_sort(list_distinct(w)), ' '), '')) AS canonical_digest FROM w""",
    ),
    "artifact_paths": (
        artifact_paths,
        rf"""WITH {_PATHS_SQL},
p AS (SELECT page_id, regexp_replace(path, '\.html$', '') || ['.html', '.json', '.pdf', '/readerState.html', '/assets/cache/a.png', '.svg'][page_id % 6 + 1] AS path FROM paths),
s AS (SELECT *, regexp_extract(path, '(\.[^./]+)$', 1) AS suffix,
   lower(' ' || regexp_replace(regexp_replace(path, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g') || ' ') AS words FROM p)
SELECT page_id, path, CASE
  WHEN regexp_matches(words, ' (archive|backup|browser|browserstate|bundle|cache|feedback|feedbackstore|favorite|favorites|localstorage|migration|private|readerstate|snapshot|state|store|zotero|local storage) ')
    OR list_has_any(string_split(lower(path), '/'), ['.env', 'cache', 'zotero', 'private'])
    OR suffix NOT IN ('.html', '.css', '.svg', '.png', '.jpg', '.jpeg', '.webp') THEN 'forbidden'
  WHEN page_id % 4 <> 0 THEN 'ok' ELSE 'undeclared' END AS verdict FROM s""",
    ),
    "run_ids": (
        run_ids,
        r"""WITH m AS (SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS made FROM events),
r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'COM1.' || made WHEN 1 THEN made || '.' ELSE made END AS run_id FROM m)
SELECT event_id, run_id, event_id % 7 > 1 AS safe, regexp_full_match(substr(run_id, 1, 10), '\d{4}-\d{2}-\d{2}') AS date_label FROM r""",
    ),
    "payload_keys": (
        payload_keys,
        "SELECT event_type, count(*) FILTER (WHERE event_id % 3 <> 0) AS allowed_count, count(*) AS n FROM events GROUP BY 1",
    ),
    "affiliations": (
        affiliations,
        """WITH w AS (SELECT item_id, string_split(text, ' ')[1:9] AS w FROM benchmark),
d AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM w)
SELECT item_id, array_to_string(u, '|') AS names,
       array_to_string(u[1:5], ', ') || CASE WHEN len(u) > 5 THEN ', ...' ELSE '' END AS shown FROM d""",
    ),
    "authors": (
        authors,
        rf"""WITH a AS (SELECT item_id, list_transform(string_split(regexp_replace(text, '[,.] ', ' ; ', 'g'), ';'),
          lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))) AS a FROM benchmark)
SELECT item_id, CAST(len(a) AS BIGINT) AS author_count,
       array_to_string(CASE WHEN len(a) > 5 THEN a[1:3] || ['...'] || a[-2:] ELSE a END, ', ') AS authors FROM a""",
    ),
    "star_buckets": (
        star_buckets,
        """WITH s AS (SELECT (c_acctbal + 1000) / 1100.0::DOUBLE AS s FROM customer)
SELECT CASE WHEN s <= 6 THEN 0 WHEN s >= 8 THEN 10 ELSE CAST(ceil((s - 6) / 0.2::DOUBLE) AS BIGINT) END AS half_stars, count(*) AS n FROM s GROUP BY 1""",
    ),
    "reader_search": (
        reader_search,
        f"""WITH {b.STATE_SQL}
SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title FROM documents d LEFT JOIN state s ON s.paper_id = d.doc_id
WHERE NOT coalesce(irrelevant, false) AND NOT coalesce(read, false)
  AND contains(lower(doc_id || ' ' || split_part(text, chr(10), 1)), 'the')""",
    ),
    "full_text_fallback": (
        full_text_fallback,
        f"""SELECT d.doc_id, md5(coalesce(i.text, {_main_text_sql('p.html')}, d.text)) AS digest
FROM documents d LEFT JOIN benchmark i ON i.item_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id""",
    ),
    "bm25_pick": (
        bm25_pick,
        """WITH q AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
qt AS (SELECT conv_id, lower(unnest(regexp_extract_all(query, '[a-zA-Z0-9]+'))) AS tok FROM q),
d AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)) AS toks
      FROM conversations JOIN q USING (conv_id) WHERE role = 'assistant'),
g AS (SELECT conv_id, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY conv_id),
tf AS (SELECT conv_id, turn, tok, count(*) AS f FROM (SELECT conv_id, turn, unnest(toks) AS tok FROM d) GROUP BY ALL),
df AS (SELECT conv_id, tok, count(*) AS n_q FROM tf GROUP BY ALL),
s AS (SELECT d.conv_id, d.turn, coalesce(sum(ln((g.n - coalesce(n_q, 0) + 0.5) / (coalesce(n_q, 0) + 0.5) + 1)
        * (coalesce(f, 0) * 2.5) / (coalesce(f, 0) + 1.5 * (0.25 + 0.75 * len(toks) / greatest(avgdl, 1)))), 0) AS score
  FROM d JOIN g USING (conv_id) LEFT JOIN qt USING (conv_id)
  LEFT JOIN df ON df.conv_id = d.conv_id AND df.tok = qt.tok
  LEFT JOIN tf ON tf.conv_id = d.conv_id AND tf.turn = d.turn AND tf.tok = qt.tok GROUP BY ALL)
SELECT conv_id, arg_max(turn, (round(score, 9), -turn)) AS turn, round(max(score), 6) + 0.0 AS score FROM s GROUP BY conv_id""",
    ),
    "profile_exclusion": (
        profile_exclusion,
        """WITH r AS (SELECT CASE event_type WHEN 'error' THEN '<lambda>' WHEN 'signup' THEN 'audit' ELSE 'observe' END AS f,
  CASE user_id % 3 WHEN 0 THEN 'daily.py' WHEN 1 THEN 'artifacts.py' ELSE 'collector.py' END AS p FROM events)
SELECT CASE WHEN f LIKE '<%' THEN 'generated_wrapper' WHEN p = 'daily.py' OR (p = 'collector.py' AND f = 'observe') THEN 'inclusive_wrapper'
            WHEN p = 'artifacts.py' AND f = 'audit' THEN 'security_invariant' END AS exclusion_code, count(*) AS n FROM r GROUP BY 1""",
    ),
}
