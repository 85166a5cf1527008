"""Import of feedback bundles as a stateful stream: bundles once, commands once, late commands remembered.

Two keyed states in one stream.  The first lets a bundle id through once.  The second keeps
the flags of a paper, the watermark of each domain and the command ids seen, in shelves, so
that a batch asks for each shelf once and not for each command; a command at or below its
domain's watermark is stale: it is remembered, and changes nothing.  Bundles that arrive
together count in the order in which they were generated.

Both states are keyed by buckets of ids and hold a map by id: a batch calls Python at most
``BUCKETS`` times for each, and its work for a bundle or paper is to look it up and to store it.

The result is one row per command with its outcome and the flags after it.  All that a
new checkpoint needs to go on is in these rows (:func:`known_bundles`, :func:`known_papers`).

Keyed state needs a state store with column families.  Spark's default store has none, so
:func:`start` gives its query the RocksDB store where the session still names the default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.session import DEFAULTS

ORDER = ("occurred_at", "device_id", "sequence", "command_id")
COMMAND = "command_id string, paper_id string, action string, value boolean, occurred_at timestamp, device_id string, sequence bigint"
PASSED = f"bundle_id string, generated_at timestamp, {COMMAND}"
OUTCOME = (
    "bundle_id string, paper_id string, command_id string, outcome string, changed boolean, conflict boolean, "
    "read boolean, favorite boolean, irrelevant boolean, read_mark string, preference_mark string, nth bigint"
)
STORE = "spark.sql.streaming.stateStore.providerClass"
PLAIN_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
#: Shelves of the command ids of a paper: a batch reads and writes only those its commands fall into.
SHELVES = 64
#: Keys of each state.  They stay with a checkpoint.
BUCKETS = 1024
FLAGS = "read boolean, favorite boolean, irrelevant boolean, read_mark string, preference_mark string, nth bigint"


def position(row) -> str:
    """A command's place in the log as text that sorts like it."""
    return f"{pd.Timestamp(row.occurred_at).value:020d}\x1f{row.device_id}\x1f{row.sequence:020d}\x1f{row.command_id}"


def shelf(command_id: str | None) -> int:
    return zlib.crc32((command_id or "").encode()) % SHELVES


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int").alias("bucket")


class Once(StatefulProcessor):
    """Passes on the commands of bundles not seen before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "bundle_id string", "applied boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for bundle_id in initialState["bundle_id"]:
            self.seen.updateValue((bundle_id,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        any_seen, chosen = self.seen.exists(), {}
        for frame in rows:
            # Of copies of a bundle in one batch the first counts; they are told apart by their row.
            for bundle_id, copy in frame[["bundle_id", "copy"]].drop_duplicates("bundle_id").itertuples(index=False):
                if bundle_id not in chosen:
                    chosen[bundle_id] = None if any_seen and self.seen.containsKey((bundle_id,)) else copy
                    if chosen[bundle_id] is not None:
                        self.seen.updateValue((bundle_id,), (True,))
            yield frame[frame["copy"] == frame["bundle_id"].map(chosen)].drop(columns=["copy", "bucket"])


class Papers(StatefulProcessor):
    """Applies commands to the flags of their paper."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getMapState("flags", "paper_id string", FLAGS)
        self.commands = handle.getMapState("commands", "paper_id string, shelf int", "command_ids array<string>")

    def shelves(self, paper_id: str, command_ids: Iterable[str | None], known: bool) -> dict[int, set]:
        """The ids on every shelf of a paper that one of ``command_ids`` belongs on; none are kept of papers not ``known``."""
        wanted = sorted({shelf(c) for c in command_ids})
        return {k: set(self.commands.getValue((paper_id, k))[0]) if known and self.commands.containsKey((paper_id, k)) else set() for k in wanted}

    def put(self, paper_id: str, shelves: dict[int, set]) -> None:
        for k, ids in shelves.items():
            self.commands.updateValue((paper_id, k), (list(ids),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.flags.updateValue((row.paper_id,), (bool(row.read), bool(row.favorite), bool(row.irrelevant), row.read_mark, row.preference_mark, int(row.nth)))
            shelves = self.shelves(row.paper_id, row.command_ids, False)
            for command_id in row.command_ids:
                shelves[shelf(command_id)].add(command_id)
            self.put(row.paper_id, shelves)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        any_known = self.flags.exists()
        out = []
        together = pd.concat(list(rows)).sort_values(["generated_at", "bundle_id", *ORDER])
        for paper_id, own in together.groupby("paper_id", sort=False):
            known = any_known and self.flags.containsKey((paper_id,))
            flags, done = self.apply(own, self.flags.getValue((paper_id,)) if known else (False, False, False, None, None, 0), known)
            self.flags.updateValue((paper_id,), flags)
            out += done
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def apply(self, own: pd.DataFrame, flags: tuple, known: bool) -> tuple[tuple, list[tuple]]:
        """The flags of a paper after its commands ``own``, and the outcomes of these."""
        read, favorite, irrelevant, read_mark, preference_mark, nth = flags
        out = []
        paper_id = own["paper_id"].iloc[0]
        shelves = self.shelves(paper_id, own["command_id"], known)
        for row in own.itertuples(index=False):
            at, changed, conflict = position(row), False, False
            mark = read_mark if row.action == "set_read" else preference_mark
            seen = shelves[shelf(row.command_id)]
            if row.command_id in seen:
                outcome = "duplicate"
            else:
                seen.add(row.command_id)
                outcome = "stale" if mark is not None and at <= mark else "applied"
            if outcome == "applied":
                before, value = (read, favorite, irrelevant), bool(row.value)
                if row.action == "set_read":
                    read, read_mark = value, at
                else:
                    conflict = value and (irrelevant if row.action == "set_favorite" else favorite)
                    if row.action == "set_favorite":
                        favorite, irrelevant = value, irrelevant and not value
                    else:
                        favorite, irrelevant = favorite and not value, value
                    preference_mark = at
                changed = before != (read, favorite, irrelevant)
            nth += 1
            out.append((row.bundle_id, row.paper_id, row.command_id, outcome, changed, bool(conflict), read, favorite, irrelevant, read_mark, preference_mark, nth))
        self.put(paper_id, shelves)
        return (read, favorite, irrelevant, read_mark, preference_mark, nth), out


def known_bundles(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("bundle_id").distinct()


def known_papers(outcomes: DataFrame) -> DataFrame:
    """State of every paper after all ``outcomes``, with the command ids it has seen."""
    flags = [c.split()[0] for c in FLAGS.split(", ")]
    last = F.max_by(F.struct(*flags), "nth").alias("s")
    seen = F.collect_set("command_id").alias("command_ids")
    return outcomes.groupBy("paper_id").agg(last, seen).select("paper_id", "s.*", "command_ids")


def outcomes(bundles: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """A stream of ``bundles`` (bundle_id, generated_at, commands) as outcomes of their commands.

    ``earlier`` holds outcomes under another checkpoint, which a new checkpoint starts from.
    A bundle without id or commands gives nothing; a null value counts as false.
    """
    numbered = bundles.where("bundle_id IS NOT NULL").withColumn("copy", F.uuid())
    one = numbered.select("bundle_id", "generated_at", "copy", F.explode("commands").alias("c"))
    names = [c.split()[0] for c in COMMAND.split(", ")]
    rows = one.select("bundle_id", "generated_at", *[F.col(f"c.{n}").alias(n) for n in names], "copy").where("paper_id IS NOT NULL")
    dealt = lambda frame, column: frame.withColumn("bucket", bucket(column)).groupBy("bucket")
    passed = dealt(rows, "bundle_id").transformWithStateInPandas(
        Once(), PASSED, "Append", "None", None if earlier is None else dealt(known_bundles(earlier), "bundle_id")
    )
    return dealt(passed, "paper_id").transformWithStateInPandas(
        Papers(), OUTCOME, "Append", "None", None if earlier is None else dealt(known_papers(earlier), "paper_id")
    )


def start(bundles: DataFrame, path: str, checkpoint: str, earlier: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
    """Append the outcomes of a bundle stream to ``path``; the sink's own log makes each batch count once."""
    conf = bundles.sparkSession.conf
    writer = outcomes(bundles, earlier).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if conf.get(STORE, PLAIN_STORE) != PLAIN_STORE:
        return writer.start(path)
    named = conf.getAll.get(STORE)
    conf.set(STORE, DEFAULTS[STORE])
    try:
        # A query copies its session's settings when it starts, so the session's own stay as they were.
        return writer.start(path)
    finally:
        conf.unset(STORE) if named is None else conf.set(STORE, named)


def counters(outcomes_: DataFrame) -> DataFrame:
    """The five counters of every bundle that was applied."""
    said = lambda name: F.count_if(F.col("outcome") == name).alias(f"{name}_count")
    return outcomes_.groupBy("bundle_id").agg(
        said("applied"), F.count_if("changed").alias("changed_count"), said("duplicate"), said("stale"), F.count_if("conflict").alias("conflict_count")
    )


def state(outcomes_: DataFrame) -> DataFrame:
    """The flags of every paper after all its commands."""
    return known_papers(outcomes_).select("paper_id", "read", "favorite", "irrelevant")
