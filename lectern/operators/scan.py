"""Ordered running aggregates that never put one key's rows into a single task.

A plain window sends every row of a key to one task.  Here each key is cut into
ordered slots, each slot is scanned on its own, and the total of the earlier
slots is carried into the later ones.  Slots come either from an expression that
grows with the order (``slot=``; nothing is materialised) or from a range
partitioning by key and order, which balances any skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.fixedpoint import int_div
from lectern.session import materialize


@dataclass(frozen=True)
class Running:
    """A running ``sum`` or ``max`` of ``value``; ``before`` leaves out the current row."""

    kind: str
    value: Column
    before: bool = False

    def over(self, column: Column) -> Column:
        return F.sum(column) if self.kind == "sum" else F.max(column)

    def join(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return F.greatest(carried, local)


def running_count() -> Running:
    return Running("sum", F.lit(1).cast("bigint"))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    scans: dict[str, Running],
    slot: Column | None = None,
    totals: dict[str, str] | None = None,
    spanning: Column | None = None,
) -> DataFrame:
    """Add one running column per entry of ``scans``, per ``keys`` in ``order``.

    ``keys`` must not be null.  ``totals`` maps a new column to a scan whose
    whole-key total it should hold.  ``spanning`` may mark the rows of keys that
    fill more than one slot; only these are then summed up for carrying.
    """
    keys = list(keys)
    totals = totals or {}
    if slot is not None:
        slotted = df.withColumn("_slot", slot)
    else:
        ranges = [F.col(k) for k in keys] + list(order)
        slotted = materialize(
            df.repartitionByRange(*ranges).withColumn("_slot", F.spark_partition_id())
        )
    work = slotted.withColumns({f"_v_{n}": s.value for n, s in scans.items()})

    carried = work if spanning is None else work.where(spanning)
    per_slot = carried.groupBy(*keys, "_slot").agg(
        *[s.over(F.col(f"_v_{n}")).alias(f"_t_{n}") for n, s in scans.items()]
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slot.select(
        *keys,
        "_slot",
        *[s.over(F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, s in scans.items()],
        *[
            scans[source].over(F.col(f"_t_{source}")).over(whole).alias(name)
            for name, source in totals.items()
        ],
        F.row_number().over(whole.orderBy("_slot")).alias("_nth"),
    )
    if not totals:
        carry = carry.where("_nth > 1")
        if slot is None:
            # A range slot continues at most one key from the slot before it, so this
            # side holds no more rows than there are partitions.
            carry = F.broadcast(carry)
    joined = work.join(carry, [*keys, "_slot"], "left")

    local = Window.partitionBy(*keys, "_slot").orderBy(*order)
    result = {}
    for name, scan in scans.items():
        frame = local.rowsBetween(Window.unboundedPreceding, -1 if scan.before else 0)
        result[name] = scan.join(F.col(f"_c_{name}"), scan.over(F.col(f"_v_{name}")).over(frame))
    return joined.withColumns(result).select(*df.columns, *scans, *totals)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in a total order, range by range."""
    return ordered_scan(df, [], order, {name: running_count()})


def nearest_rank_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[int]
) -> DataFrame:
    """Exact nearest-rank percentiles ``ceil(p * n / 100)`` per key, one column ``p<p>`` each.

    Equal values are counted before anything is ordered, and the counts are then
    accumulated with :func:`ordered_scan`, so a hot key spreads over many tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    scanned = ordered_scan(
        counted, keys, [F.col(value)], {"_upto": Running("sum", F.col("_n"))}, totals={"_all": "_upto"}
    )
    picks = []
    for p in percentiles:
        target = int_div(F.col("_all") * p + 99, F.lit(100))
        picks.append(F.min(F.when(F.col("_upto") >= target, F.col(value))).alias(f"p{p}"))
    return scanned.groupBy(*keys).agg(F.max("_all").alias("n"), *picks)
