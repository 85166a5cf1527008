"""Fetchers that answer from a stored Parquet table: an archived listing instead of a live service.

``path`` may be any location pyarrow can open, a file or a folder of files.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds


def _fragments(path: str) -> list:
    pieces = []
    for fragment in ds.dataset(path, format="parquet").get_fragments():
        pieces.extend(fragment.split_by_row_group())
    return pieces


def _rows(table) -> list[tuple]:
    return list(zip(*(column.to_pylist() for column in table.columns)))


def by_ids(ids: Iterable, path: str, key: str, columns: list[str]) -> list[tuple]:
    """Rows whose ``key`` is asked for; row groups without any of the ids are not read."""
    return _rows(ds.dataset(path, format="parquet").to_table(columns=columns, filter=ds.field(key).isin(list(ids))))


@dataclass
class _Listing:
    """A listing being paged through: its row groups and the rows found in the one read last."""

    pieces: list
    group: int = -1
    found: pa.Table | None = None


#: The listing that was paged last; a task follows one after the other.
_last: dict[tuple, _Listing] = {}


def by_cursor(
    listing: str, cursor: str | None, path: str, field: str, columns: list[str], page_size: int
) -> tuple[list[tuple], str | None]:
    """One page of the rows whose ``field`` is ``listing``; the cursor is a row group and a place in it.

    Pages asked for in order read the footers once and every row group once, and hold the
    listing's rows of one row group.  A first page looks at the files anew.
    """
    group, start = (0, 0) if cursor is None else map(int, cursor.split(":"))
    key = (listing, path, field, tuple(columns))
    state = _last.pop(key, None)
    if cursor is None or state is None:
        state = _Listing(_fragments(path))
    if group >= len(state.pieces):
        return [], None
    if group != state.group:
        state.group, state.found = group, state.pieces[group].to_table(columns=columns, filter=ds.field(field) == listing)
    page = _rows(state.found.slice(start, page_size))
    if start + page_size < state.found.num_rows:
        following = f"{group}:{start + page_size}"
    else:
        following = f"{group + 1}:0" if group + 1 < len(state.pieces) else None
    _last.clear()
    if following is not None:
        _last[key] = state
    return page, following
