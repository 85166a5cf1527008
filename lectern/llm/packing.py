"""Best-fit decreasing packing of tokenised documents into fixed windows.

Documents are tokenised where they are read and cut into full windows and one rest.  Only
narrow piece rows move: they are dealt into groups of bounded size, and each group is
packed on its own.  A segment tree over remaining capacities finds the tightest open
window for each rest, longest first.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import whole_text
from lectern.session import materialize

WINDOW = 2048
#: The id that ends every document.
END_ID = 1
#: Pieces packed together; the unfilled last windows of a group are negligible beside it.
GROUP_PIECES = 20_000
#: Words whose ids a worker remembers before it starts afresh.
MEMO_WORDS = 700_000
#: Marks that are split off a word; after an ASCII letter or digit the tokenizer separates them too.
TAIL = b".,;:!?%&*#$"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group_key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[int, str]:
    """The character that byte-level merges use for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder:
    """Token ids of texts through a memo of words.

    The tokenizer drops white space before its merges, so no token crosses it, and the
    ids of a text are those of its words one after another.  Marks after an ASCII letter
    or digit at the end of a word are split off, and what is then only letters goes
    straight to the merges.  After anything else the tokenizer may join them: a run of
    marks is one piece, and letters such as U+0130 end in a combining mark once normalised.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.letters = byte_letters()

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        # Letter by letter: the tokenizer knows no final form of sigma.
        plain = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        if plain.isalpha() and (plain.isascii() or unicodedata.is_normalized("NFC", text)):
            if not plain.isascii():
                plain = "".join(map(self.letters.__getitem__, plain.encode()))
            ids = [t.id for t in self.tokenizer.model.tokenize(plain)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, word: bytes) -> bytes:
        core = word.rstrip(TAIL)
        if not core[-1:].isalnum():
            core = word
        known = self.memo.get(core)
        if known is None:
            known = self.memo[core] = self._ids(core)
        if len(core) < len(word):
            tail = word[len(core):]
            marks = self.memo.get(tail)
            if marks is None:
                marks = self.memo[tail] = self._ids(tail)
            known = self.memo[word] = known + marks
        return known

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        words = text.encode().split()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for word in set(words):
            if word not in self.memo:
                self._learn(word)
        return b"".join(map(self.memo.__getitem__, words))


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


class TightestWindow:
    """A segment tree over remaining capacities that answers "least capacity of at least n"."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the tightest window with at least ``need`` left, removed from the tree."""
        node = need + self.leaves
        while not self.open[node]:
            while node & 1:  # a right child: nothing further right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.open[node]:
                node += 1
        room = node - self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; longest pieces first, ties in the given order."""
    tree, placed, opened = TightestWindow(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = (window, opened)
            opened += 1
        room, number = found
        placed[i] = (number, window - room)
        if room > lengths[i]:
            tree.add(room - lengths[i], number)
    return placed


def pieces(docs: DataFrame, tokenizer_path: str, group: Column | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows of a document and its rest.  ``group`` keeps rows together in packing."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, key in zip(*(c.to_pylist() for c in batch.columns)):
                encoded = memoryview(encode(text) + end)
                total = len(encoded) // 4
                for start in range(0, total, window):
                    part = encoded[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group_key"],
            )

    chosen = docs.select(
        F.col("doc_id").cast("bigint"), whole_text().alias("text"), (F.lit(0) if group is None else group).cast("bigint").alias("key")
    )
    return chosen.mapInArrow(cut, PIECES)


def stored_runs(docs: DataFrame, rows: int = 4096) -> DataFrame | None:
    """doc_id, text and the number of the ``run`` of ``rows`` consecutive rows of the files that ``docs`` reads.

    Runs are numbered in the order of files and rows: files by their part number, then by
    name.  Packed by these numbers, sequence ids grow in the order in which the rows were
    written.  None if ``docs`` does not read files.
    """
    try:
        placed = docs.select(
            "doc_id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")
        )
    except AnalysisException:
        return None

    def order(path: str) -> tuple[int, str, str]:
        name = path.rsplit("/", 1)[-1]
        part = re.match(r"part-(\d+)", name)
        return int(part[1]) if part else -1, name, path

    last = {r.path: r.last for r in placed.groupBy("path").agg(F.max("row").alias("last")).collect()}  # one row per file
    paths = sorted(last, key=order)
    firsts = [0, *itertools.accumulate(last[p] // rows + 1 for p in paths)]
    files = docs.sparkSession.createDataFrame(
        pa.table({"path": pa.array(paths, pa.string()), "first": pa.array(firsts[:-1], pa.int64())})
    )
    run = F.col("first") + F.floor(F.col("row") / rows)
    return placed.join(F.broadcast(files), "path").select("doc_id", "text", run.alias("run"))


def pack_pieces(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pack piece rows, each ``group_key`` on its own; sequence ids are unique over all groups."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), window)
        first = table.column("group_key")[0].as_py() << 32
        numbers = pa.array([first + n for n, _ in placed], pa.int64())
        offsets = pa.array([o for _, o in placed], pa.int64())
        return (
            table.drop_columns(["group_key"]).append_column("sequence_id", numbers).append_column("offset", offsets)
        )

    return cut.groupBy("group_key").applyInArrow(pack, PACKED)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, group: Column | None = None, window: int = WINDOW
) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty and a document of one id, the end id.  Documents longer than a
    window give full windows and a rest; repeated rows are packed as often as they occur;
    a null ``doc_id`` stays null.  No documents give no rows.  Pieces are packed with
    others of the same ``group``, a key of less than 31 bits that should hold a bounded
    number of rows; without it they are dealt by hash into groups of about
    ``GROUP_PIECES``.
    """
    cut = materialize(pieces(docs, tokenizer_path, group, window))
    if group is None:
        groups = max(1, -(-cut.count() // GROUP_PIECES))
        cut = cut.withColumn("group_key", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return pack_pieces(cut, window)


def pack_stored(docs: DataFrame, tokenizer_path: str, rows: int = 4096) -> DataFrame:
    """Pack the rows of written files, each run of ``rows`` on its own, with sequence ids in the order of the runs."""
    runs = stored_runs(docs, rows)
    if runs is None:
        return pack_documents(docs, tokenizer_path)
    return pack_documents(runs, tokenizer_path, group=F.col("run"))
