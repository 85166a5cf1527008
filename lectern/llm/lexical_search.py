"""Ranked search of all documents for many items at once, without an index.

The terms of the items stand in one Aho-Corasick automaton, each between two guards.  A
document has everything but terms turned into guards, so the automaton finds whole terms
only, and counts them straight from the text.  Its outputs map to the items that hold
the term.

The documents are read twice: once for the corpus counts (documents, occurrences,
documents per term), once to score.  Of each item every task passes on its best documents
alone, and the best of these are ranked.  Items come in blocks of bounded text, and every
block is held against all documents; a block is what the driver and the automaton hold.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.common import whole_text

#: Best documents of an item.
TOP = 20
#: Size of a block: characters of its distinct terms, and eight for every item and posting; more make another block.
BLOCK_SIZE = 1_000_000
#: Scores (documents by items), and outputs of terms to items, that a task holds at once.
HELD_SCORES = 500_000
SCALE = 1_000_000_000
GUARD = " "
#: Every byte that is no part of a term becomes a guard; A-Z become a-z.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

RANKED = "item_id long, rank int, doc_id long, score long"
_second = itemgetter(1)


def guarded(text: str) -> tuple[str, int]:
    """The text's terms between guards, and how many they are."""
    found = text.encode().translate(_BYTES)
    return f"{GUARD}{found.decode()}{GUARD}", len(found.split())


@dataclass
class Block:
    """Items and their terms: ``postings`` lists for every term the items that hold it, and how often."""

    item_ids: list[int | None] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    size: int = 0
    postings: list[Counter] = field(default_factory=list)

    def add(self, item_id: int | None, text: str) -> None:
        item = len(self.item_ids)
        self.item_ids.append(item_id)
        self.size += 8
        for word in guarded(text)[0].split(GUARD):
            if not word:
                continue
            if word not in self.terms:
                self.terms[word] = len(self.postings)
                self.size += len(word) + 2
                self.postings.append(Counter())
            posting = self.postings[self.terms[word]]
            self.size += 8 * (item not in posting)
            posting[item] += 1

    def packed(self) -> dict:
        """Postings as arrays: those of term ``t`` lie from ``starts[t]`` to ``starts[t + 1]``."""
        return {
            "token": uuid.uuid4().hex,
            "n_items": len(self.item_ids),
            "terms": list(self.terms),
            "starts": np.cumsum([0, *map(len, self.postings)]).astype(np.int64),
            "items": np.array([i for p in self.postings for i in p], np.int64),
            "times": np.array([n for p in self.postings for n in p.values()], np.int64),
        }


def blocks(items: DataFrame, block_size: int = BLOCK_SIZE) -> Iterator[Block]:
    """The items (item_id, text) in blocks of bounded size, partition by partition of the table."""
    block = Block()
    for row in items.select(F.col("item_id").cast("bigint"), whole_text().alias("text")).toLocalIterator():
        block.add(row.item_id, row.text)
        if block.size >= block_size:
            yield block
            block = Block()
    if block.item_ids:
        yield block


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(packed: dict) -> ahocorasick.Automaton:
    """The automaton of a block, built once per worker process."""
    if packed["token"] not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for number, term in enumerate(packed["terms"]):
            automaton.add_word(f"{GUARD}{term}{GUARD}", number)
        automaton.make_automaton()
        _built[packed["token"]] = automaton
    return _built[packed["token"]]


def _count(shared: Broadcast):
    """Documents per term of the block; term -1 counts documents with terms, term -2 their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        documents: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found, n = guarded(text)
                if n:
                    documents[-1] += 1
                    documents[-2] += n
                    documents.update(set(map(_second, automaton.iter(found))))
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(documents.keys(), pa.int64()), "n": pa.array(documents.values(), pa.int64())}
        )

    return run


class Best:
    """The best documents of every item so far: higher score, then lower id, null ids last."""

    def __init__(self, top: int, n_items: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)
        self.columns = [np.empty(0, np.int64) for _ in range(4)]  # item, score, whether without id, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents by items."""
        row, item = np.nonzero(scores >= self.least)
        new = (item, scores[row, item], null[row], ids[row])
        item, score, none, own = (np.concatenate(pair) for pair in zip(self.columns, new))
        order = np.lexsort((own, none, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
        nth = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        stay = order[nth < self.top]
        self.columns = [c[stay] if k else item[nth < self.top] for k, c in enumerate((item, score, none, own))]
        last = nth[nth < self.top] == self.top - 1
        self.least[self.columns[0][last]] = self.columns[1][last]


def _score(shared: Broadcast, weights: Broadcast, top: int):
    """Of every item of the block the best documents of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        automaton, n_items = _automaton(packed), packed["n_items"]
        starts, items, times = packed["starts"], packed["items"], packed["times"]
        weight, n_documents, n_terms = weights.value
        sizes = np.diff(starts)
        best = Best(top, n_items)
        per_group = max(1, HELD_SCORES // n_items)
        group: list[tuple[int | None, int, Counter]] = []
        outputs = 0

        def settle() -> None:
            rows = np.repeat(np.arange(len(group)), [len(c) for _, _, c in group])
            term = np.array([t for _, _, c in group for t in c], np.int64)
            tf = np.array([n for _, _, c in group for n in c.values()], np.int64)
            norm = np.array([75 + 25 * n * n_documents // n_terms for _, n, _ in group], np.int64)[rows]
            value = weight[term] * (SCALE * tf // (1000 * tf + 12 * norm))
            many = sizes[term]
            at = np.repeat(starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            scores = np.zeros(len(group) * n_items, np.int64)
            np.add.at(scores, np.repeat(rows * n_items, many) + items[at], np.repeat(value, many) * times[at])
            ids = [d for d, _, _ in group]
            best.add(
                scores.reshape(len(group), n_items),
                np.array([d is None for d in ids], np.int64),
                np.array([0 if d is None else d for d in ids], np.int64),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = guarded(text)
                counts = Counter(map(_second, automaton.iter(found)))
                if counts:
                    group.append((doc_id, n, counts))
                    outputs += int(sizes[list(counts)].sum())
                if len(group) >= per_group or outputs > HELD_SCORES:
                    settle()
                    group, outputs = [], 0
        if group:
            settle()
        item, score, none, own = best.columns
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(own, mask=none.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return run


def _search_block(docs: DataFrame, block: Block, top: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block.packed())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    # One row per term of the block, whose text is bounded.
    counted = texts.select("text").mapInArrow(_count(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r.term: r.n for r in counted.collect()}
    weight = [math.floor(1000 * math.log((2 * n.get(-1, 0) + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(block.terms))]
    weights = spark.sparkContext.broadcast((np.array(weight, np.int64), n.get(-1, 0), n.get(-2, 0)))
    found = texts.mapInArrow(_score(shared, weights, top), "item long, doc_id long, score long")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(block.item_ids)), "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text), by score.

    Other columns are left out.  A null text has no terms.  Rows that repeat in ``docs`` are
    documents of their own; equal scores go by id, null ids last; rows that repeat in
    ``items`` each get their ranks.  Items without terms or hits, and empty tables, give no rows.
    Returns item_id, rank, doc_id, score.
    """
    result = None
    for block in blocks(items, block_size):
        if block.terms:
            found = _search_block(docs, block, top)
            result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], RANKED) if result is None else result
