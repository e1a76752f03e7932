"""Evidence as a stream: every micro-batch is decided against what earlier ones had accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.evidence import Limits, archive


def run(stream: DataFrame, store: str, checkpoint: str, limits: Limits = Limits()) -> StreamingQuery:
    """stream: event_id, shop_key, reason, html, captured_at. The store is `accepted` and `objects` by batch, written so that a batch may come twice."""
    step = lambda batch, number: archive(batch, number, store, limits)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
