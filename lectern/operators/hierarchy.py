"""Resolving parent chains of trees that may contain cycles and dangling parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.session import materialize

OK, CYCLE, MISSING = "ok", "collection_cycle", "missing_collection"


def ancestor_paths(nodes: DataFrame, key: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """``key, path, depth, status`` for every node, root first in ``path``.

    Each round every open node takes over the path of the node it points to, so
    the distance covered doubles and a tree of depth d needs about log2(d) joins.
    A round that settles nothing proves that the open nodes run into a cycle.
    """
    base = nodes.select(
        F.col(key).alias("key"),
        F.nullif(F.col(parent), F.lit("")).alias("_next") if dict(nodes.dtypes)[parent] == "string"
        else F.col(parent).alias("_next"),
        F.array(F.col(name)).alias("_names"),
        F.lit(OK).alias("status"),
    )
    known = base.select(F.col("key").alias("_known"))
    state = (
        base.join(known, F.col("_next") == F.col("_known"), "left")
        .withColumn(
            "status",
            F.when(F.col("_next").isNotNull() & F.col("_known").isNull(), MISSING).otherwise(OK),
        )
        .withColumn("_next", F.when(F.col("_known").isNotNull(), F.col("_next")))
        .drop("_known")
    )
    open_before = None
    while True:
        state = materialize(state)
        still_open = state.where("_next IS NOT NULL").count()
        if still_open == 0 or still_open == open_before:
            break
        open_before = still_open
        target = state.select(
            F.col("key").alias("_key"),
            F.col("_next").alias("_after"),
            F.col("_names").alias("_above"),
            F.col("status").alias("_status"),
        )
        state = state.join(target, F.col("_next") == F.col("_key"), "left").select(
            "key",
            F.col("_after").alias("_next"),
            F.when(F.col("_key").isNull(), F.col("_names"))
            .otherwise(F.concat("_above", "_names"))
            .alias("_names"),
            F.when(F.col("_key").isNull(), F.col("status")).otherwise(F.col("_status")).alias("status"),
        )
    status = F.when(F.col("_next").isNotNull(), CYCLE).otherwise(F.col("status"))
    return state.select(
        F.col("key").alias(key),
        F.when(status == OK, F.array_join("_names", separator)).alias("path"),
        F.when(status == OK, F.size("_names").cast("bigint")).alias("depth"),
        status.alias("status"),
    )


def item_paths(items: DataFrame, item: str, keys: str, paths: DataFrame, key: str) -> DataFrame:
    """Sorted distinct paths of each item and how many of its keys could not be resolved."""
    exploded = items.select(item, F.explode_outer(keys).alias("_key"))
    joined = exploded.join(paths.select(F.col(key).alias("_key"), "path", "status"), "_key", "left")
    broken = F.col("_key").isNotNull() & (F.coalesce("status", F.lit(MISSING)) != OK)
    return joined.groupBy(item).agg(
        # An item lists only the few collections it is filed in.
        F.array_sort(F.collect_set("path")).alias("paths"),
        F.count_if(broken).alias("broken_keys"),
        F.count("_key").alias("listed_keys"),
    )
