"""Listings for the paged, keyed and cursor sources."""

import uuid


def numbers(start, limit):
    for k in range(start, start + limit):
        yield (k, f"item {k}")


def named(ids, calls):
    """Rows of the ids below 1000 and one that nobody asked for; each call leaves a file."""
    with open(f"{calls}/{uuid.uuid4().hex}", "w") as log:
        log.write(",".join(map(str, ids)))
    return [(k, f"item {k}") for k in ids if k < 1000] + [(5000, "unasked")]


def chained(listing, cursor):
    """Three pages of two rows in each listing, except that ``loop`` never ends and ``empty`` has no rows."""
    at = 0 if cursor is None else int(cursor)
    if listing == "empty":
        return [], None
    if listing == "loop":
        return [], "1"
    return [(listing, at * 2), (listing, at * 2 + 1)], None if at == 2 else str(at + 1)


def offline(ids):
    raise TimeoutError("no answer")
