"""Removal of repeated byte strings by prefix doubling within blocks.

Every byte position is named by the string that starts there.  Names of 1, 2, 4, 8, 16, 24,
48 and 50 bytes each come from the pair of shorter names at two offsets, inside one block
and without Spark.  Only names of 24 and 50 bytes are exchanged between blocks: of
neighbouring positions the one with the least inner name of a window is looked up first,
then what is still open.  Names are 64-bit hashes of name pairs rather than dense ranks, so
that a position can be named without a table of all ranks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.repeats import Analysis, Repeats, repeated_units
from lectern.llm.words import mixed

#: Length in bytes of a repeated string, and of the names that represent it.
THRESHOLD, INNER = 50, 24
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _units(texts: list[bytes]) -> list[np.ndarray]:
    return [_BYTES[np.frombuffer(t, np.uint8)] for t in texts]


def _finish(found: Analysis, covered: np.ndarray) -> pa.Table:
    rows = []
    for i, text in enumerate(found.texts):
        mask = covered[found.starts[i] : found.starts[i + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        spans = ",".join(f"{a}:{b}" for a, b in edges.reshape(-1, 2))
        rows.append((int(found.doc_ids[i]), len(text), int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), spans))
    columns = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64()] * 4 + [pa.string()] * 2
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Bytes of each text that lie in a ``THRESHOLD``-byte string of an earlier document.

    Needs doc_id and text; other columns are ignored and rows without an id are left out.
    A null text is empty.  Strings are those of the input, may overlap and do not cross
    documents; earlier means a smaller doc_id, so rows that repeat an id do not remove each
    other's bytes.  No documents give no rows.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end of the removed
    runs in bytes, comma-joined).
    """
    return repeated_units(docs, Repeats(THRESHOLD, INNER, _units), _finish, RESULT)
