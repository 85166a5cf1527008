"""Folding a log of reader commands into per-paper state.

Commands carry ``paper_id, action, value, occurred_at, device_id, sequence,
command_id`` and are ordered by the last four.  There are two independent
domains, *read* and *preference*; favourite and irrelevant exclude each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.constraints import differs, row_issues
from lectern.operators.scan import Running, ordered_scan

LOG_ORDER = ["occurred_at", "device_id", "sequence", "command_id"]


def log_position() -> Column:
    return F.struct(*LOG_ORDER)


def _is(action: str) -> Column:
    return F.col("action") == action


def _decides_favorite() -> Column:
    return _is("set_favorite") | (_is("set_irrelevant") & F.col("value"))


def _decides_irrelevant() -> Column:
    return _is("set_irrelevant") | (_is("set_favorite") & F.col("value"))


def _last(value: Column, position: Column, where: Column) -> Column:
    return F.max_by(F.when(where, value), F.when(where, position))


def replay(commands: DataFrame) -> DataFrame:
    """State after replaying the whole log: the last deciding command of each flag wins.

    A pure aggregate, so each map task sends one row per paper and a paper that
    owns most of the log causes no skew.
    """
    at = log_position()
    favorite = _is("set_favorite") & F.col("value")
    irrelevant = _is("set_irrelevant") & F.col("value")
    return commands.groupBy("paper_id").agg(
        F.coalesce(_last(F.col("value"), at, _is("set_read")), F.lit(False)).alias("read"),
        F.coalesce(_last(favorite, at, _decides_favorite()), F.lit(False)).alias("favorite"),
        F.coalesce(_last(irrelevant, at, _decides_irrelevant()), F.lit(False)).alias("irrelevant"),
        F.max(F.when(_is("set_read"), F.col("occurred_at"))).alias("read_watermark"),
        F.max(F.when(~_is("set_read"), F.col("occurred_at"))).alias("preference_watermark"),
    )


def projection(state: DataFrame) -> DataFrame:
    """State as (paper_id, flag) rows, the shape the ranking joins read."""
    flags = F.array_compact(
        F.array(*[F.when(F.col(f), F.lit(f)) for f in ("read", "favorite", "irrelevant")])
    )
    return state.select("paper_id", F.explode(flags).alias("flag"))


def command_effects(commands: DataFrame) -> DataFrame:
    """Each command with ``duplicate``, ``changed`` and ``conflict`` flags from an in-order replay."""
    first = (
        commands.groupBy("command_id")
        .agg(F.count("*").alias("_copies"), F.min_by(F.struct("*"), log_position()).alias("_row"))
        .select("_row.*", (F.col("_copies") - 1).alias("duplicates"))
    )

    def before(where: Column, flag: Column) -> Running:
        return Running("max", F.when(where, F.struct(*LOG_ORDER, flag.alias("flag"))), before=True)

    favorite = _is("set_favorite") & F.col("value")
    irrelevant = _is("set_irrelevant") & F.col("value")
    scanned = ordered_scan(
        first,
        ["paper_id"],
        [F.col(c) for c in LOG_ORDER],
        {
            "_read": before(_is("set_read"), F.col("value")),
            "_favorite": before(_decides_favorite(), favorite),
            "_irrelevant": before(_decides_irrelevant(), irrelevant),
        },
    )
    was = {n: F.coalesce(F.col(f"_{n}")["flag"], F.lit(False)) for n in ("read", "favorite", "irrelevant")}
    next_favorite = F.when(_is("set_favorite"), F.col("value")).otherwise(
        ~F.col("value") & was["favorite"]
    )
    next_irrelevant = F.when(_is("set_irrelevant"), F.col("value")).otherwise(
        ~F.col("value") & was["irrelevant"]
    )
    changed = F.when(_is("set_read"), was["read"] != F.col("value")).otherwise(
        (next_favorite != was["favorite"]) | (next_irrelevant != was["irrelevant"])
    )
    conflict = F.when(
        F.col("value"),
        F.when(_is("set_favorite"), was["irrelevant"]).when(_is("set_irrelevant"), was["favorite"]),
    )
    return scanned.select(
        *commands.columns,
        "duplicates",
        changed.alias("changed"),
        F.coalesce(conflict, F.lit(False)).alias("conflict"),
    )


def merge_counters(effects: DataFrame, keys: list[str]) -> DataFrame:
    return effects.groupBy(*keys).agg(
        F.count("*").alias("applied_count"),
        F.count_if("changed").alias("changed_count"),
        F.sum("duplicates").alias("duplicate_count"),
        F.count_if("conflict").alias("conflict_count"),
    )


def out_of_order(bundle: DataFrame, bundle_key: str, position: str) -> DataFrame:
    """Commands that stand before their predecessor in the log order of their bundle."""
    scanned = ordered_scan(
        bundle, [bundle_key], [F.col(position)], {"_before": Running("max", log_position(), before=True)}
    )
    return scanned.where(F.col("_before") > log_position()).drop("_before")


MAX_BUNDLE_COMMANDS = 500


def bundle_digest() -> Column:
    """SHA-256 of a bundle's content as JSON with alphabetical keys, without the digest itself."""
    commands = F.transform(
        "commands",
        lambda c: F.struct(
            *[c[f].alias(f) for f in ("action", "command_id", "device_id", "occurred_at", "paper_id", "sequence", "value")]
        ),
    )
    content = F.struct(F.col("bundle_id"), commands.alias("commands"), F.col("generated_at"), F.col("schema_version"))
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def bundle_issues(bundles: DataFrame) -> DataFrame:
    """Rules of an exported bundle, which is one row of at most a few hundred commands."""
    places = F.transform("commands", lambda c: F.struct(*[c[f].alias(f) for f in LOG_ORDER]))
    ids = F.transform("commands", lambda c: c["command_id"])
    return row_issues(
        bundles,
        {
            "bundle_too_large": F.size("commands") > MAX_BUNDLE_COMMANDS,
            "bundle_not_ordered": F.array_sort(places) != places,
            "bundle_repeats_command": F.size(F.array_distinct(ids)) != F.size(ids),
            "bundle_digest_mismatch": differs(F.col("digest"), bundle_digest()),
        },
        paper_id="bundle_id",
        field_path=F.lit("commands"),
    )
