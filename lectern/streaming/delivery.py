"""Delivery with a ledger: a request is claimed, sent, and confirmed once the sending returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.caching import undelivered
from lectern.session import materialize


CLAIMED, CONFIRMED = "claimed", "confirmed"


def entries(batch: DataFrame, ledger: str, key: str, state: str) -> DataFrame:
    """Ledger rows in a state, (key, batch_id, idempotency_key); none before the first delivery."""
    spark = batch.sparkSession
    schema = f"{key} {dict(batch.dtypes)[key]}, batch_id bigint, idempotency_key string"
    try:
        return spark.read.schema(schema).parquet(f"{ledger}/{state}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def start(
    requests: DataFrame, key: str, order: list[str], ledger: str, checkpoint: str, send: Callable[[DataFrame], None]
) -> StreamingQuery:
    """Send each key until one sending of it returned; ``send`` gets the rows with an ``idempotency_key``.

    Claims enter the ledger before they are sent and confirmations after.  A batch that
    is repeated after a failed send sends its unconfirmed claims again under the same
    idempotency key, by which a receiver knows them; confirmed keys are never sent again.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        open_ = undelivered(batch, entries(batch, ledger, key, CONFIRMED), key, order)
        claims = materialize(open_.withColumn("idempotency_key", F.sha2(F.col(key).cast("string"), 256)))
        rows = claims.select(key, F.lit(batch_id).cast("bigint").alias("batch_id"), "idempotency_key")
        new = rows.join(entries(batch, ledger, key, CLAIMED).select(key), key, "left_anti")
        materialize(new).write.mode("append").parquet(f"{ledger}/{CLAIMED}")
        send(claims)
        rows.write.mode("append").parquet(f"{ledger}/{CONFIRMED}")

    return (
        requests.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
