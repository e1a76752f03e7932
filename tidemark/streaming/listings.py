"""Observations as a stream: each micro-batch is folded into a state table by the batch function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ingest import fold


def run(stream: DataFrame, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], clock: Callable[[int], str], checkpoint: str, complete: bool = False) -> StreamingQuery:
    """write_state gets the next state and the batch's number, and must be idempotent by that number: a batch may come twice."""

    def step(batch: DataFrame, number: int) -> None:
        write_state(fold(read_state(), batch, clock(number), complete), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
