"""Looking up sources by name and falling back from one source to the next."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def keep(source: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SOURCES[name] = source
        return source

    return keep


def get(name: str) -> Callable[..., DataFrame]:
    if name not in _SOURCES:
        raise ValueError(f"source {name!r} is not registered; known: {sorted(_SOURCES)}")
    return _SOURCES[name]


class SourceUnavailable(Exception):
    """Raised by a source that cannot deliver now; the next one is tried."""


def first_available(attempts: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that answers: for instance today's cache, the API, the feeds, an older cache."""
    failure: Exception | None = None
    for attempt in attempts:
        try:
            return attempt()
        except SourceUnavailable as error:
            failure = failure or error
    raise failure or SourceUnavailable("no source was given")


def merged_config(base: dict[str, Any], custom: dict[str, Any]) -> dict[str, Any]:
    """``custom`` laid over ``base``, nested mappings key by key."""
    merged = dict(base)
    for key, value in custom.items():
        both = isinstance(value, dict) and isinstance(merged.get(key), dict)
        merged[key] = merged_config(merged[key], value) if both else value
    return merged


_VARIABLE = re.compile(r"\$\{oc\.env:\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:,([^{}]*))?\}")


def with_environment(config: Any, environment: Mapping[str, str]) -> Any:
    """``${oc.env:NAME}`` and ``${oc.env:NAME,default}`` in strings at any depth, replaced from ``environment``.

    The default ``null`` alone in a value gives None.  A name that is neither set nor has
    a default stops with an error that names it; values put in are not read again.
    """
    if isinstance(config, dict):
        return {k: with_environment(v, environment) for k, v in config.items()}
    if isinstance(config, list):
        return [with_environment(v, environment) for v in config]
    if not isinstance(config, str):
        return config
    whole = _VARIABLE.fullmatch(config)
    if whole and whole[1] not in environment and whole[2] is not None and whole[2].strip() == "null":
        return None

    def value(found: re.Match[str]) -> str:
        if found[1] in environment:
            return environment[found[1]]
        if found[2] is None:
            raise ValueError(f"environment variable {found[1]!r} is not set and has no default")
        return found[2].strip()

    return _VARIABLE.sub(value, config)


def without_empty(config: Any) -> Any:
    """Drop nulls, blank strings and containers that end up empty."""
    if isinstance(config, dict):
        pruned = {k: without_empty(v) for k, v in config.items()}
        return {k: v for k, v in pruned.items() if v not in (None, "", {}, [])}
    if isinstance(config, list):
        return [v for v in map(without_empty, config) if v not in (None, "", {}, [])]
    return config
