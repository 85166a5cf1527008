"""Attempts, tokens and cost of model stages, observed while their results are written.

Metrics ride on the job that writes the rows; no second job reads them again.  An
observer that fails leaves the rows as they are and is reported as failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lectern.functions.fixedpoint import token_estimate


def model_metrics(prompt: Column, answer: Column, attempts: Column | None = None, cost_micro_usd: Column | None = None) -> dict[str, Column]:
    """What is counted of a model stage; a null answer is a failed one, tokens are estimates from bytes."""
    tries = F.lit(1) if attempts is None else attempts
    cost = F.lit(0) if cost_micro_usd is None else cost_micro_usd
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return {
        "attempt_count": total(tries),
        "retry_count": total(tries - 1),
        "failed_count": F.count_if(answer.isNull()),
        "input_tokens": total(tries * token_estimate(F.coalesce(prompt, F.lit("")))),
        "output_tokens": total(token_estimate(F.coalesce(answer, F.lit("")))),
        "cost_micro_usd": total(cost),
    }


def observed_write(rows: DataFrame, metrics: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int] | None:
    """``write(rows)`` and the ``metrics`` of the rows it wrote; None where these could not be collected.

    Metrics that cannot be resolved are left out before the job starts.  Metrics that fail
    within the job fail the write, which is then done again without them.
    """
    try:
        observation = Observation()
        watched = rows.observe(observation, *[c.alias(n) for n, c in metrics.items()])
        watched.schema  # resolves the metrics
    except Exception:  # noqa: BLE001 - whatever is wrong with the observer, the rows come first
        write(rows)
        return None
    try:
        write(watched)
    except Exception:  # noqa: BLE001 - a failure of the rows themselves comes up again below
        write(rows)
        return None
    try:
        return dict(observation.get)
    except Exception:  # noqa: BLE001
        return None


class StreamUsage(StreamingQueryListener):
    """Sums the metrics that streams observe under ``name``; a batch that is repeated counts once.

    Register with ``spark.streams.addListener``; ``totals`` holds what has been seen so far.
    """

    def __init__(self, name: str):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    @property
    def totals(self) -> dict[str, int]:
        result: dict[str, int] = {}
        for values in self.batches.values():
            for key, value in values.items():
                result[key] = result.get(key, 0) + (value or 0)
        return result

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event) -> None:
        pass
