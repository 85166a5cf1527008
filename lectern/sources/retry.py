"""Retrying remote reads inside a task: which failures pass, and how long to wait."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import TypeVar

T = TypeVar("T")


class HttpFailure(Exception):
    def __init__(self, status: int, retry_after: str | None = None) -> None:
        super().__init__(f"HTTP status {status}")
        self.status = status
        self.retry_after = retry_after


def is_transient(error: Exception) -> bool:
    if isinstance(error, HttpFailure):
        return error.status in (408, 425, 429) or error.status >= 500
    return isinstance(error, (TimeoutError, ConnectionError))


def requested_wait(header: str | None, now: datetime, limit: float) -> float | None:
    """Seconds a server asks to wait, given as a number or as an HTTP date, within 0 and ``limit``."""
    if header is None:
        return None
    try:
        seconds = float(header)
    except ValueError:
        try:
            seconds = (parsedate_to_datetime(header) - now).total_seconds()
        except (TypeError, ValueError):
            return None
    return min(max(seconds, 0.0), limit) if math.isfinite(seconds) else None


def backoff(attempt: int, base: float, limit: float, linear: bool = False) -> float:
    return min(base * attempt if linear else base * 2 ** (attempt - 1), limit)


def with_retries(
    call: Callable[[], T], attempts: int = 3, base: float = 1.0, limit: float = 30.0,
    sleep: Callable[[float], None] = time.sleep, linear: bool = False,
) -> T:
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if attempt == attempts or not is_transient(error):
                raise
            asked = requested_wait(getattr(error, "retry_after", None), datetime.now(timezone.utc), limit)
            sleep(backoff(attempt, base, limit, linear) if asked is None else asked)
    raise ValueError("attempts must be positive")
