"""Windows of text that occur in an earlier document, found by names of growing length.

Texts are cut into blocks of documents once.  In each block every position gets a name for
the string that starts there, a hash of the pair of names at two offsets, so that names of
twice the length come from those of one length.  Names that decide something are sent,
once per block, to the shard of the name space they fall into; shards sort what they get
and reply to the blocks that asked:

1. Every window is represented by its least inner name.  Those in one document only are
   unique and drop out, and with them nearly all positions.
2. Consecutive windows with the same representative form a run.  Runs that an earlier
   document has as a whole are settled; representatives with more than one run are open.
3. For runs still open each window's full name is looked up.

A block sends a name once, so even a string that stands in every document is no more than
one entry per block to a shard.  No step looks at pairs of documents.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import release, shared_path, whole_text
from lectern.llm.words import mixed
from lectern.session import materialize

#: UTF-8 bytes of a block of documents, and of text per shard of the name space.
BLOCK_BYTES, SHARD_BYTES = 3 << 19, 8 << 20
#: Windows that are named at a time.
STRETCH = 1 << 14
ROW = "block long, doc_ids binary, lengths binary, texts binary"
NAMES = "block long, kind int, shard long, keys binary, values binary, flags binary"
#: Kinds of names: representatives, whole runs, runs of a representative, windows.
SEEDS, RUNS, OPEN, WINDOWS = range(4)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def blocks(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Documents packed into compressed blocks, bucketed by block, and the number of shards."""
    spark, most = docs.sparkSession, block_bytes or BLOCK_BYTES
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            ids: list[int] = []
            held: list[bytes] = []
            size = 0

            def close() -> None:
                if ids:
                    own, blob = np.array(ids, np.int64).tobytes(), b"".join(held)
                    name = int.from_bytes(hashlib.blake2b(own + blob, digest_size=8).digest(), "little", signed=True)
                    lengths = np.array(list(map(len, held)), np.int64).tobytes()
                    rows.append({"block": name, "doc_ids": own, "lengths": lengths, "texts": zstandard.compress(blob)})
                    ids.clear()
                    held.clear()

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                held.append(text.encode())
                size += len(held[-1])
                if size >= most:
                    close()
                    size = 0
            close()
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary())])
            )

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "blocks")
    name = "blocks_" + path.rsplit("-", 1)[-1]
    (
        texts.mapInArrow(pack, ROW).repartition(buckets, "block")
        .write.format("parquet").bucketBy(buckets, "block").option("path", path).option("compression", "none").saveAsTable(name)
    )
    table = spark.table(name)
    release(spark)
    total = table.agg(F.sum(F.length("texts"))).first()[0]
    return table, 1 << max(0, (3 * (total or 0) // SHARD_BYTES).bit_length())


def paired(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of the strings that a name and the one ``offset`` further on cover together."""
    n = max(0, len(names) - offset)
    out = names[:n] * _A
    other = names[offset : offset + n] * _B
    out += other
    np.right_shift(out, np.uint64(29), out=other)
    out ^= other
    out *= _C
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        done += step
    return values


@dataclass
class Repeats:
    """Windows of ``window`` units, represented by names of ``inner`` units."""

    window: int
    inner: int
    units: Callable[[list[bytes]], list[np.ndarray]]

    def grown(self, names: np.ndarray, length: int, wanted: int) -> np.ndarray:
        """Names of ``wanted`` units from names of ``length`` units by doubling."""
        while length < wanted:
            step = min(length, wanted - length)
            names = paired(names, step)
            length += step
        return names

    def names(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of ``inner`` and of ``window`` units."""
        inner = self.grown(units, 1, self.inner)
        return inner, self.grown(inner, self.inner, self.window)

    def windows(self, units: np.ndarray, name: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``name`` of all windows, worked out in stretches that stay in a core's cache."""
        n = max(0, len(units) - self.window + 1)
        out = np.empty(n, np.uint64)
        for a in range(0, n, STRETCH):
            b = min(a + STRETCH, n)
            out[a:b] = name(units[a : b + self.window - 1])
        return out

    def representatives(self, units: np.ndarray) -> np.ndarray:
        """The least inner name in each window."""
        return sliding_least(self.grown(units, 1, self.inner), self.window - self.inner + 1)

    def analyse(self, rows: list[dict]) -> "Analysis":
        ids, texts = [], []
        for row in rows:
            blob, at = zstandard.decompress(row["texts"]), 0
            ids.append(np.frombuffer(row["doc_ids"], np.int64))
            for n in np.frombuffer(row["lengths"], np.int64):
                texts.append(blob[at : at + n])
                at += n
        doc_ids = np.concatenate(ids)
        order = np.argsort(doc_ids, kind="stable")
        texts = [texts[i] for i in order]
        own = self.units(texts)
        lengths = np.array([len(u) for u in own], np.int64)
        units = np.concatenate(own) if own else np.empty(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        least = self.windows(units, self.representatives)
        # Starts of windows that stay within their document.
        usable = np.flatnonzero(lengths >= self.window)
        windows = lengths[usable] - self.window + 1
        owner = np.repeat(usable, windows)
        ahead = np.concatenate([[0], np.cumsum(windows)[:-1]]) if len(usable) else windows
        at = np.arange(len(owner)) + np.repeat(starts[usable] - ahead, windows)
        seed = least[at]
        first = np.ones(len(at), bool)
        first[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
        run_start = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        doc_ids = doc_ids[order]
        return Analysis(self, doc_ids, texts, starts, at, owner, units, run, run_start, seed[run_start], doc_ids[owner[run_start]])


def per_name(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least value of each, and whether it has several values."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(keys)) - 1 if len(starts) else starts
    return keys[starts], values[starts], values[starts] != values[ends]


@dataclass
class Analysis:
    """A block's windows (place, document, run) and runs (first window, representative, document)."""

    kind: Repeats
    doc_ids: np.ndarray
    texts: list[bytes]
    starts: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    units: np.ndarray
    run: np.ndarray
    run_start: np.ndarray
    run_seed: np.ndarray
    run_doc: np.ndarray

    @functools.cached_property
    def name(self) -> np.ndarray:
        """The name of each window; the first step does without."""
        return self.kind.windows(self.units, lambda part: self.kind.names(part)[1])[self.at]

    def run_names(self, chosen: np.ndarray) -> np.ndarray:
        """Names of the chosen runs, from the names and places of their windows."""
        if not len(chosen):
            return np.empty(0, np.uint64)
        lengths = np.diff(np.append(self.run_start, len(self.at)))[chosen]
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(lengths.sum()) - np.repeat(begins, lengths)
        weights = mixed(np.arange(1, lengths.max() + 1, dtype=np.uint64) * _A) | np.uint64(1)
        names = self.name[place + np.repeat(self.run_start[chosen], lengths)]
        return mixed(np.add.reduceat(names * weights[place], begins))

    def repeated(self, replies: dict[int, "Reply"]) -> np.ndarray:
        """Numbers of the runs whose representative occurs in several documents."""
        return np.flatnonzero(replies[SEEDS].has(self.run_seed))

    def settled(self, replies: dict[int, "Reply"]) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the runs that an earlier document has as a whole, and of those whose windows are to be asked for."""
        whole, open_runs = np.zeros(len(self.run_seed), bool), np.zeros(len(self.run_seed), bool)
        chosen = self.repeated(replies)
        doc = self.run_doc[chosen]
        earlier = replies[RUNS].least(self.run_names(chosen), doc) < doc
        whole[chosen[earlier]] = True
        rest = chosen[~earlier]
        open_runs[rest] = replies[OPEN].has(self.run_seed[rest])
        return whole, open_runs

    def requests(self, step: int, replies: dict[int, "Reply"]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, values, flags) to ask for in ``step``; a flag says that the block alone has several values."""
        if step == 0:
            keys, _, several = per_name(self.run_seed, self.run_doc)
            return [(SEEDS, keys, np.empty(0, np.int64), several)]
        if step == 1:
            chosen = self.repeated(replies)
            seed, name, doc = self.run_seed[chosen], self.run_names(chosen), self.run_doc[chosen]
            return [(RUNS, *per_name(name, doc)), (OPEN, *per_name(seed, name.view(np.int64)))]
        chosen = np.flatnonzero(self.settled(replies)[1][self.run])
        return [(WINDOWS, *per_name(self.name[chosen], self.doc_ids[self.owner[chosen]]))]

    def covered(self, replies: dict[int, "Reply"]) -> np.ndarray:
        """Whether each unit is in a window that also starts in an earlier document."""
        whole, open_runs = self.settled(replies)
        hit = whole[self.run]
        chosen = np.flatnonzero(open_runs[self.run])
        doc = self.doc_ids[self.owner[chosen]]
        hit[chosen] = replies[WINDOWS].least(self.name[chosen], doc) < doc
        change = np.zeros(self.starts[-1] + 1, np.int32)
        # Windows start at different places, so no place is named twice.
        begins = self.at[hit]
        change[begins] += 1
        change[begins + self.kind.window] -= 1
        return np.cumsum(change[:-1]) > 0


@dataclass
class Reply:
    """Names that other blocks or documents have too, with the least value."""

    keys: np.ndarray
    values: np.ndarray

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, names), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == names) if len(self.keys) else np.zeros(len(names), bool)

    def has(self, names: np.ndarray) -> np.ndarray:
        return self._find(names)[1]

    def least(self, names: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        at, found = self._find(names)
        return np.where(found, self.values[at] if len(self.values) else otherwise, otherwise)


def _replies(table: pa.Table) -> dict[int, Reply]:
    parts: dict[int, list[tuple]] = {k: [] for k in range(4)}
    for row in table.select(["kind", "shard", "keys", "values"]).to_pylist():
        parts[row["kind"]].append((row["shard"], np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["values"], np.int64)))
    # Shards split the names in order, so sorted by shard they are sorted.
    out = {}
    for kind, rows in parts.items():
        rows.sort(key=lambda r: r[0])
        out[kind] = Reply(
            np.concatenate([k for _, k, _ in rows]) if rows else np.empty(0, np.uint64),
            np.concatenate([v for _, _, v in rows]) if rows else np.empty(0, np.int64),
        )
    return out


def _answer(table: pa.Table) -> pa.Table:
    """Reply to every block: the names of this shard that several documents (or runs) have."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    sizes = np.array([len(k) for k in keys])
    asker = np.repeat(np.arange(len(rows)), sizes)
    name = np.concatenate(keys)
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows]).astype(bool)
    values = np.concatenate([np.frombuffer(r["values"], np.int64) for r in rows]) if kind != SEEDS else asker
    order = np.lexsort((values, name))
    name, values, flags, asker = name[order], values[order], flags[order], asker[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    last = np.append(starts[1:], len(name)) - 1
    several = (values[starts] != values[last]) | np.logical_or.reduceat(flags, starts)
    keep = several[group]
    least = values[starts][group]
    by = np.argsort(asker[keep], kind="stable")
    kept_asker, kept_name, kept_least = asker[keep][by], name[keep][by], least[keep][by]
    bounds = np.searchsorted(kept_asker, np.arange(len(rows) + 1))
    result = {"block": [], "kind": [], "shard": [], "keys": [], "values": [], "flags": []}
    for i, row in enumerate(rows):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            result["block"].append(row["block"])
            result["kind"].append(kind)
            result["shard"].append(shard)
            result["keys"].append(kept_name[a:b].tobytes())
            result["values"].append(b"" if kind in (SEEDS, OPEN) else kept_least[a:b].tobytes())
            result["flags"].append(b"")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(result.items(), kinds)})


def repeated_units(docs: DataFrame, kind: Repeats, finish: Callable[[Analysis, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``finish`` of every block with the mask of its covered units."""
    table, shards = blocks(docs)
    bits = np.uint64(64 - (shards.bit_length() - 1))
    def asker(step: int) -> Callable[[pa.Table, dict[int, Reply]], pa.Table]:
        def ask(own: pa.Table, known: dict[int, Reply]) -> pa.Table:
            out = []
            for which, keys, values, flags in kind.analyse(own.to_pylist()).requests(step, known) if own.num_rows else []:
                at = keys >> bits if shards > 1 else np.zeros(len(keys), np.uint64)
                edges = np.searchsorted(at, np.arange(shards + 1, dtype=np.uint64))
                for shard in range(shards):
                    a, b = edges[shard], edges[shard + 1]
                    if b > a:
                        out.append(
                            {
                                "block": own.column("block")[0].as_py(), "kind": which, "shard": shard, "keys": keys[a:b].tobytes(),
                                "values": values[a:b].tobytes(), "flags": flags[a:b].astype(np.uint8).tobytes(),
                            }
                        )
            return pa.Table.from_pylist(out, schema=_schema())

        return ask

    def first(own: pa.Table) -> pa.Table:
        return asker(0)(own, {})

    asked = table.groupBy("block").applyInArrow(first, NAMES)
    replies = materialize(asked.groupBy("kind", "shard").applyInArrow(_answer, NAMES))
    for step in (1, 2):
        ask = asker(step)

        def later(own: pa.Table, known: pa.Table) -> pa.Table:
            return ask(own, _replies(known))

        asked = table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later, NAMES)
        replies = replies.unionByName(materialize(asked.groupBy("kind", "shard").applyInArrow(_answer, NAMES)))
        release(docs.sparkSession)

    def end(own: pa.Table, known: pa.Table) -> pa.Table:
        found = kind.analyse(own.to_pylist())
        return finish(found, found.covered(_replies(known)))

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(end, schema)


def _schema() -> pa.Schema:
    return pa.schema(
        [("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("flags", pa.binary())]
    )
