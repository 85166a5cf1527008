"""Pfair interleaving of sources to target weights.

A source is cut into blocks of equal length in characters.  With weight ``w`` its block
``i`` may start at ``floor(i / w)`` and is due by ``ceil((i + 1) / w)``; the block with the
earliest deadline among those released is placed in each slot, so that after every slot
each source is less than one block away from its share.

Weights are taken exactly, as ratios of whole numbers.  The driver goes through the slots
once, keeps only the state of the sources, and writes the slot of every block in chunks;
documents are joined with the slots of their blocks.  When a source runs out, the rest
goes on in a new phase, and the deviation is counted from the start of the phase.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm.common import shared_path, whole_text
from lectern.operators.scan import Running, ordered_scan
from lectern.session import materialize

#: Characters of a source block.
BLOCK_CHARS = 1 << 16
#: Slots written at a time.
CHUNK = 1 << 18
LAST = (1 << 63) - 1

SLOTS = pa.schema([("source_key", pa.string()), *((n, pa.int64()) for n in ("block", "phase", "slot", "release", "deadline"))])


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of ``weights``."""
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    ratios = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(r.denominator for r in ratios.values()))
    return {s: int(r * common) for s, r in ratios.items()}


def integer_weights(weights: dict[str, float], resolution: int = 1024) -> dict[str, int]:
    """Whole parts of ``resolution`` in proportion to ``weights``, at least one each (largest remainder)."""
    if not weights:
        return {}
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources need a resolution of at least as many parts, not {resolution}")
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    free, total = resolution - len(weights), sum(weights.values())
    exact = {s: free * w / total for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    left = resolution - sum(parts.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        parts[s] += 1
    return parts


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one period, by earliest deadline among released blocks."""
    total = sum(parts.values())
    slots: dict[str, list[int]] = {s: [] for s in parts}
    waiting = [(0, s) for s in sorted(parts)]  # by release
    ready: list[tuple[int, str]] = []  # by deadline
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // parts[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < parts[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // parts[s], s))
    return slots


@dataclass
class Phase:
    """A run of slots during which every one of its sources still has blocks."""

    number: int
    offset: int
    slots: dict[str, list[int]]
    first: dict[str, int]

    @property
    def length(self) -> int:
        return sum(map(len, self.slots.values()))

    def slot(self, source: str, i: int) -> int:
        own = self.slots[source]
        return self.length * (i // len(own)) + own[i % len(own)]

    def count(self, source: str, until: int) -> int:
        """Blocks of ``source`` in the first ``until`` slots."""
        own = self.slots[source]
        return until // self.length * len(own) + sum(t < until % self.length for t in own)


def phases(blocks: dict[str, int], parts: dict[str, int]) -> list[Phase]:
    """Phases that place ``blocks`` of every source; each ends with the last block of a source."""
    placed, result, offset = {s: 0 for s in blocks}, [], 0
    while active := {s: parts[s] for s in blocks if placed[s] < blocks[s]}:
        phase = Phase(len(result), offset, period(active), {s: placed[s] for s in active})
        result.append(phase)
        ends = {s: phase.slot(s, blocks[s] - placed[s] - 1) + 1 for s in active}
        until = min(ends.values())
        for s in active:
            placed[s] += phase.count(s, until)
        offset += until
    return result


def placements(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline) of every block, slot by slot.

    Sources of which nothing was placed in a phase yet all have their first block
    released, and among them the largest weight is due first.  So they wait in a chain
    by weight, and a new phase costs nothing for sources that it does not reach.
    """
    names = sorted(blocks, key=lambda s: (-parts[s], s))
    n, weight, last = len(names), [parts[s] for s in names], [blocks[s] for s in names]
    after, before = [*range(1, n + 1), 0], [n, *range(n)]  # a ring: place n closes it and leads to its head
    placed, begun, total, offset = [0] * n, [0] * n, sum(weight), 0
    for phase in itertools.count():
        fresh, t = after[n], 0
        if fresh == n:
            return
        waiting: list[tuple[int, int]] = []  # by release
        ready: list[tuple[int, int]] = []  # by deadline
        while True:
            while waiting and waiting[0][0] <= t:
                _, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(placed[k] - begun[k] + 1) * total // weight[k]), k))
            first = (-(-total // weight[fresh]), fresh) if fresh < n else None
            if first and (not ready or first < ready[0]):
                due, k = first
                begun[k], fresh = placed[k], after[fresh]
            else:
                due, k = heapq.heappop(ready)
            i = placed[k] - begun[k]
            yield names[k], placed[k], phase, offset + t, offset + i * total // weight[k], min(offset + due, LAST)
            placed[k] += 1
            t += 1
            if placed[k] == last[k]:
                break
            heapq.heappush(waiting, ((i + 1) * total // weight[k], k))
        after[before[k]], before[after[k]] = after[k], before[k]
        total -= weight[k]
        offset += t


def _periodic(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """What :func:`placements` gives, from periods of small whole weights; equal deadlines go by name."""
    plan = phases(blocks, parts)
    for p, following in zip(plan, [*plan[1:], None]):
        for s, own in p.slots.items():
            for b in range(p.first[s], following.first.get(s, blocks[s]) if following else blocks[s]):
                i, n = b - p.first[s], len(own)
                yield s, b, p.number, p.offset + p.slot(s, i), p.offset + i * p.length // n, p.offset - (-(i + 1) * p.length // n)


def _written(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """``rows`` of ``SLOTS`` as a table in the shared folder; the driver holds one chunk at a time."""
    path = shared_path(spark, "slots")
    chunk = list(itertools.islice(rows, CHUNK))
    while True:
        columns = list(zip(*chunk)) or [[]] * len(SLOTS)
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SLOTS)], schema=SLOTS)
        frame = spark.createDataFrame(table)
        frame.write.mode("append").parquet(path)
        if not (chunk := list(itertools.islice(rows, CHUNK))):
            return spark.read.schema(frame.schema).parquet(path)


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def schedule(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.5,
    block_chars: int = BLOCK_CHARS,
    resolution: int | None = None,
) -> DataFrame:
    """The place of every document in the mixture.

    Needs doc_id, text, source; other columns are ignored.  ``weights`` gives the target
    weight of each source, and a source without one is an error; by default the weight is
    the source's characters to the power of ``exponent``, which lifts small sources.
    Weights are exact unless a ``resolution`` asks to round them to so many parts.  A
    null source is a source of its own.  Within a source the order is a hash of the id.
    A null text has no characters; a text longer than a block takes up the following
    slots too.  Rows that repeat source and id travel together as one row with their
    number in ``copies``.  No documents give no rows.

    Returns doc_id, source, copies, block, phase, slot, release, deadline, position (from 0,
    without gaps, by slot).
    """
    spark = docs.sparkSession
    units = docs.groupBy(_source_key().alias("source_key"), _id_key().alias("id_key")).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("source").alias("source"),
        F.count("*").alias("copies"),
        F.sum(F.length(whole_text())).alias("chars"),
    )
    units = units.withColumn("mixed", F.xxhash64("id_key"))
    scanned = ordered_scan(
        units, ["source_key"], [F.col("mixed"), F.col("id_key")], {"before": Running("sum", F.col("chars"), before=True)}
    )
    placed = materialize(
        scanned.select(
            "source_key", "id_key", "doc_id", "source", "copies", "chars", "mixed",
            F.floor(F.col("before") / block_chars).alias("block"),
        )
    )
    totals = placed.groupBy("source_key").agg(F.max("block").alias("last"), F.sum("chars").alias("chars"))
    found = totals.collect()  # one row per source
    blocks = {r.source_key: r["last"] + 1 for r in found}
    if weights is None:
        wanted = {r.source_key: max(r.chars, 1) ** exponent for r in found}
    else:
        given = {"" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := sorted(set(blocks) - set(given)):
            raise ValueError(f"no weight for the sources {missing}")
        wanted = {s: given[s] for s in blocks}
    if resolution is None:
        rows = placements(blocks, exact_weights(wanted))
    else:
        rows = _periodic(blocks, integer_weights(wanted, resolution))
    slotted = placed.join(_written(spark, rows), ["source_key", "block"])
    ranked = ordered_scan(
        slotted,
        [],
        [F.col("slot"), F.col("mixed"), F.col("id_key"), F.col("source_key")],
        {"position": Running("sum", F.lit(1).cast("bigint"), before=True)},
    )
    return ranked.select("doc_id", "source", "copies", "block", "phase", "slot", "release", "deadline", "position")


def mix_rows(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """All rows of ``docs`` sorted by their place in the mixture, columns unchanged.

    Written as Parquet, the files hold the mixture in the order of their names and rows.
    """
    places = schedule(docs, weights).select(
        _source_key().alias("_source"), _id_key().alias("_id"), F.col("position").alias("_position")
    )
    matched = docs.join(places, (_source_key() == F.col("_source")) & (_id_key() == F.col("_id")))
    return matched.orderBy("_position").select(docs.columns)
