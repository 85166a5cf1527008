"""URL policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
REDACTED = "https://redacted.invalid/credential-url-rejected"
# Payload keys a workflow cache may hold.
CACHE_PAYLOAD_KEYS = (
    "artifact_hash", "byte_count", "cache_hit_count", "file_count", "pipeline_version", "schema_version", "status",
)
# What a published artifact path may and may not contain.
ALLOWED_SUFFIXES = (".html", ".css", ".svg", ".png", ".jpg", ".jpeg", ".webp", ".json", ".js")
EVIDENCE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")
FORBIDDEN_PARTS = (
    ".env", "cache", "zotero", "feedback.json", "favorites.json", "reader-state.json", ".reader-state.json", "private",
)
PRIVATE_TOKENS = (
    "archive", "backup", "browser", "browserstate", "bundle", "cache", "feedback", "feedbackstore", "favorite",
    "favorites", "localstorage", "migration", "private", "readerstate", "snapshot", "state", "store", "zotero",
)
PRIVATE_PAIRS = (("browser", "state"), ("local", "storage"), ("reader", "state"))
REVIEWED_SCRIPT = "assets/feedback.js"
BUILD_MANIFEST = "build-manifest.json"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)$", 1).try_cast("int")


def sanitized(url: Column) -> Column:
    """Scheme, host, port and path in canonical case; user, query and fragment dropped."""
    tail = F.when(port(url).isNotNull(), F.concat(F.lit(":"), port(url).cast("string"))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), tail, path(url))


def allowed_download(url: Column, hosts: list[str]) -> Column:
    """HTTPS on an allow-listed host, without credentials, on the default port."""
    return (
        (scheme(url) == "https")
        & host(url).isin(*[h.lower() for h in hosts])
        & ~authority(url).contains("@")
        & F.coalesce(port(url) == 443, F.lit(True))
    )


def display_https(url: Column) -> Column:
    """The URL where it may be shown, else null."""
    bare = F.trim(url)
    good = (scheme(bare) == "https") & (authority(bare) != "") & ~authority(bare).contains("@")
    return F.when(good, bare)


def redacted(url: Column) -> Column:
    """Replace any URL that carries credentials."""
    squeezed = F.regexp_replace(url, r"\s+", "")
    return F.when(squeezed.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*@"), REDACTED).otherwise(url)


def private_tokens(tokens: Column) -> Column:
    """True where path words name private state, alone or as an adjacent pair."""
    pairs = F.transform(
        F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b")),
        lambda p: F.concat_ws(" ", p["a"], p["b"]),
    )
    named = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in PRIVATE_TOKENS]))
    paired = F.arrays_overlap(pairs, F.array(*[F.lit(" ".join(p)) for p in PRIVATE_PAIRS]))
    return named | paired


def artifact_verdict(relative: Column, tokens: Column, declared: Column) -> Column:
    """``ok``, ``forbidden`` or ``undeclared`` for a path inside a published artifact."""
    parts = F.split(F.lower(relative), "/")
    suffix = F.lower(F.regexp_extract(relative, r"[^/.][^/]*?(\.[^./]+)$", 1))
    forbidden = (
        ((relative != REVIEWED_SCRIPT) & private_tokens(tokens))
        | F.exists(parts, lambda p: p.isin(*FORBIDDEN_PARTS) | p.startswith(".env."))
        | ~suffix.isin(*ALLOWED_SUFFIXES)
        | ((suffix == ".json") & (relative != BUILD_MANIFEST))
        | ((suffix == ".js") & (relative != REVIEWED_SCRIPT))
    )
    evidence = (
        (F.size(parts) >= 3)
        & (parts[0] == "assets")
        & (F.get(parts, F.lit(1)) == "evidence")
        & suffix.isin(*EVIDENCE_SUFFIXES)
    )
    return F.when(forbidden, "forbidden").when(declared | evidence, "ok").otherwise("undeclared")


def cache_payload_allowed(payload: Column) -> Column:
    """True where a JSON value has only allow-listed keys at every depth; case, blanks around and dashes do not matter."""
    # What a backslash escapes becomes a mark that no listed key holds; then a quote always ends
    # a string, strings are taken one after another, and a colon only ever follows a key.
    plain = F.regexp_replace(payload, r"(?s)\\.", "\x01")
    strings = F.regexp_extract_all(plain, F.lit(r'("[^"]*"\s*:?)'), F.lit(1))
    keys = F.transform(
        F.filter(strings, lambda s: s.endswith(":")),
        lambda s: F.translate(F.lower(F.trim(F.regexp_extract(s, r'(?s)^"(.*)"\s*:$', 1))), "-", "_"),
    )
    return F.forall(keys, lambda k: k.isin(*CACHE_PAYLOAD_KEYS))
