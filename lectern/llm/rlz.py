"""Removal of repeated passages by looking up their windows in indexed blocks.

Every block of documents is a reference.  Its index holds the names of its passages and is
spread over shards by name, so a document is looked up against all blocks at once.  A word
goes if a window of ``FACTOR`` words around it stands in an earlier document.  There is no
left-to-right Lempel-Ziv parse: what is returned as a factor is a run of covered words,
which may join matches from several documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.repeats import Analysis, Repeats, repeated_units
from lectern.llm.words import word_hashes

#: Words of the shortest factor, and of the names that represent it in the index.
FACTOR, INNER = 50, 16
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors string"


def _units(texts: list[bytes]) -> list[np.ndarray]:
    return [word_hashes(t.split()) for t in texts]


def factors(covered: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the duplicate stretches of a document."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def _finish(found: Analysis, covered: np.ndarray) -> pa.Table:
    rows = []
    for i, text in enumerate(found.texts):
        words = text.split()
        mask = covered[found.starts[i] : found.starts[i + 1]]
        own = factors(mask)
        kept = b" ".join([w for w, gone in zip(words, mask) if not gone]) if own else b" ".join(words)
        rows.append(
            (int(found.doc_ids[i]), len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in own))
        )
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def remove_passages(docs: DataFrame) -> DataFrame:
    """Words of each text that lie in a window of ``FACTOR`` words of an earlier document.

    Needs doc_id and text; other columns are ignored and rows without an id are left out.
    Words are separated by ASCII white space and compared unchanged; a null text has none.
    Windows are those of the input and do not cross documents; earlier means a smaller
    doc_id, so rows that repeat an id do not remove each other's words.  No documents give
    no rows.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and
    factors (first:end of the duplicate stretches in words, comma-joined).
    """
    return repeated_units(docs, Repeats(FACTOR, INNER, _units), _finish, RESULT)
