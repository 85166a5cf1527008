"""Text normalisation as column expressions."""

from __future__ import annotations

import glob
import string

from pyspark.sql import Column, functions as F

# Patterns and word lists that decide results.
SECTION_NUMBER = r"(?i)^\s*(?:(?:[A-Z]\.\d+(?:\.\d+)*|\d+(?:\.\d+)*)(?:[.):])?|[A-Z][.):])\s+"
VISUAL_LABEL = r"(?i)^\s*(?:fig(?:ure)?\.?|table)\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)"
PAPER_ID = r"(?i)^(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v[1-9]\d*)?$"
PAPER_ID_IN_URL = r"(?i)((?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5}))(?:v(\d+))?$"
SAFE_RUN_ID = r"^[A-Za-z0-9._-]+$"
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL"] + [f"COM{i}" for i in range(1, 10)] + [f"LPT{i}" for i in range(1, 10)]
)
MARKDOWN_SPECIAL = r"([\\`*_{}\[\]()#+\-.!|>~])"
SECTION_PRIORITIES = (
    (0, ("introduction", "motivation", "observation", "analysis")),
    (1, ("method", "approach", "framework", "algorithm")),
    (2, ("experiment", "result", "evaluation")),
    (3, ("ablation",)),
    (4, ("appendix", "supplement")),
)
ABSTRACT_TITLES = ("abstract", "summary")
OTHER_PRIORITY, ABSTRACT_PRIORITY = 5, 6
# White space as Unicode knows it, plus the four separator controls.
SPACE = r"[\s\x{1c}-\x{1f}]"


def collapse(text: Column) -> Column:
    """Trim and squeeze every run of white space to one blank."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x{1c}-\x{1f}]"), F.lit(False))


def normalized_title(title: Column) -> Column:
    unnumbered = F.regexp_replace(title, SECTION_NUMBER, "")
    return F.trim(F.regexp_replace(F.lower(unnumbered), "[^a-z]+", " "))


def abstract_only(titles: Column) -> Column:
    """True for a non-empty path of normalised titles that are all abstract headings."""
    return (F.size(titles) > 0) & F.forall(titles, lambda t: t.isin(*ABSTRACT_TITLES))


def _any_matches(titles: Column, pattern: str) -> Column:
    return F.exists(titles, lambda t: t.rlike(pattern))


def section_priority(titles: Column) -> Column:
    """Priority of a path of normalised titles; the first matching keyword group decides."""
    chosen = F.when(F.lit(False), F.lit(0))
    for priority, words in SECTION_PRIORITIES:
        chosen = chosen.when(_any_matches(titles, "|".join(words)), F.lit(priority))
    return chosen.when(abstract_only(titles), F.lit(ABSTRACT_PRIORITY)).otherwise(F.lit(OTHER_PRIORITY))


def visual_label(caption: Column, kind: Column) -> Column:
    number = F.regexp_extract(caption, VISUAL_LABEL, 1)
    name = F.when(kind == "table", "Table").otherwise("Figure")
    return F.when(number != "", F.concat_ws(" ", name, number))


def feedback_paper_id(raw: Column) -> Column:
    """Identifier without prefix and version, lower case; null where it is not an identifier."""
    bare = F.regexp_replace(strip(raw), "(?i)^arxiv:", "")
    base = F.lower(F.regexp_replace(bare, r"(?i)v[1-9]\d*$", ""))
    return F.when(bare.rlike(PAPER_ID) & ~raw.rlike(r"[\x00-\x1f]"), base)


def paper_id_of_url(url: Column) -> Column:
    base = F.regexp_extract(url, PAPER_ID_IN_URL, 1)
    return F.when(base != "", base)


def version_of_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PAPER_ID_IN_URL, 2).try_cast("int"), F.lit(1))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit("([a-z0-9]+)"), 1)


def path_tokens(path: Column) -> Column:
    """Words of a path, split at punctuation and at lower-to-upper case changes, in lower case."""
    spaced = F.regexp_replace(path, "([a-z0-9])(?=[A-Z])", "$1 ")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def safe_run_id(run_id: Column) -> Column:
    stem = F.upper(F.split_part(run_id, F.lit("."), F.lit(1)))
    return run_id.rlike(SAFE_RUN_ID) & ~run_id.rlike(r"[. ]$") & ~stem.isin(*RESERVED_NAMES)


def run_id_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")


def is_date_label(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def escape_markdown(text: Column, missing: str) -> Column:
    """One escaped line for a Markdown card; blank text becomes ``missing``."""
    escaped = escape_html(F.regexp_replace(collapse(text), MARKDOWN_SPECIAL, r"\\$1"))
    return F.when(not_blank(text), escaped).otherwise(F.lit(missing))


def clean_latex(source: Column) -> Column:
    """Drop comments and disabled passages, squeeze blank lines and runs of blanks."""
    for pattern, replacement in (
        (r"%[^\n]*\n", "\n"),
        (r"(?s)\\begin\{comment\}.*?\\end\{comment\}", ""),
        (r"(?s)\\iffalse.*?\\fi", ""),
        (r"\n+", "\n"),
        (r"\\\\", ""),
        (r"[ \t\r\f]{3,}", " "),
    ):
        source = F.regexp_replace(source, pattern, replacement)
    return source


def main_text(html: Column) -> Column:
    """Readable text of a page: hidden and navigation parts, tables and tags removed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "nav", "header", "footer", "aside", "form", "table"):
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    text = F.regexp_replace(text, r'(?is)<div class="ad">.*?</div>', " ")
    text = F.regexp_replace(text, r"(?i)<(?:/p|/h[1-6]|/li|/div|br)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, plain in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def full_text(*sources: Column) -> Column:
    """The first source that is available, in the given order."""
    return F.coalesce(*sources)


def json_list(answer: Column) -> Column:
    """Distinct strings of the first bracketed list in a model answer."""
    found = F.regexp_extract(answer, r"(?s)\[.*?\]", 0)
    return F.array_distinct(F.from_json(F.when(found != "", found), "array<string>"))


def unfenced(answer: Column) -> Column:
    """A model answer without byte-order mark and without its surrounding code fence."""
    bare = F.regexp_replace(strip(answer), "^\\x{feff}+", "")
    return F.regexp_replace(bare, r"(?si)^```(?:json)?[ \t]*\n(.*)\n```$", "$1")


def short_authors(authors: Column) -> Column:
    many = F.concat(F.slice(authors, 1, 3), F.array(F.lit("...")), F.slice(authors, -2, 2))
    return F.array_join(F.when(F.size(authors) > 5, many).otherwise(authors), ", ")


def short_affiliations(affiliations: Column) -> Column:
    shown = F.array_join(F.slice(affiliations, 1, 5), ", ")
    tail = F.when(F.size(affiliations) > 5, ", ...").otherwise("")
    return F.coalesce(F.concat(shown, tail), F.lit("Unknown Affiliation"))


def half_stars(score: Column) -> Column:
    """Number of half stars: none up to 6, ten from 8 on, linear between."""
    return (
        F.when(score <= 6, F.lit(0))
        .when(score >= 8, F.lit(10))
        .otherwise(F.ceil((score - 6) / 0.2))
        .cast("bigint")
    )


def glob_regex(pattern: str) -> str:
    """Java regular expression of a recursive path glob."""
    return "^" + glob.translate(pattern, recursive=True).replace(r"\Z", r"\z")


def matches_any(path: Column, patterns: list[str]) -> Column:
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | path.rlike(glob_regex(pattern))
    return matched
