"""Work queues as tables: stale work, claims, outcomes, compaction, retention. One writer (the driver) applies each result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(selections: list[DataFrame], queue: DataFrame) -> DataFrame:
    """New work from stale selections in priority order, each (listing_id, work_type): one item a listing, none queued yet."""
    all_ = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(selections)])
    first = Window.partitionBy("listing_id").orderBy("_p", "work_type")
    rows = all_.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_p")
    rows = rows.withColumn("work_key", F.concat_ws(":", "work_type", F.col("listing_id").cast("string")))
    return rows.join(queue.select("work_key"), "work_key", "left_anti")


def claim(queue: DataFrame, now: str, n: int) -> DataFrame:
    """The next n items: pending and due, or processing with an expired lease; by priority, availability, id."""
    at = F.lit(now).cast("timestamp")
    due = ((F.col("status") == "pending") & (F.col("available_at") <= at)) | ((F.col("status") == "processing") & (F.col("lease_expires_at") < at))
    return queue.where(due & (F.col("attempt_count") < F.col("max_attempts"))).orderBy(F.desc("priority"), "available_at", "id").limit(n)


def backoff_minutes(failures: Column) -> Column:
    """min(24 h, 15 * 2^min(f - 1, 6)) minutes; none without a failure."""
    return F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1440.0), 15 * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6)))))


def settle(claimed: DataFrame, outcome: Column, now: str) -> DataFrame:
    """Claimed items after their run. outcome: true resolved, false failed; failed items wait, the last attempt is final."""
    at = F.lit(now).cast("timestamp")
    tries = F.col("attempt_count") + 1
    status = F.when(outcome, "resolved").when(tries >= F.col("max_attempts"), "failed").otherwise("pending")
    wait = F.timestamp_seconds(at.cast("long") + (backoff_minutes(tries) * 60).cast("long"))
    return claimed.withColumns({"status": status, "attempt_count": tries, "available_at": F.when(status == "pending", wait).otherwise(F.col("available_at")), "lease_expires_at": F.lit(None).cast("timestamp")})


def retain(rows: DataFrame, at: str, cutoff: str, batch: int, id_col: str) -> DataFrame:
    """The oldest rows before the cutoff, at most a batch: what a retention run deletes."""
    return rows.where(F.col(at) < F.lit(cutoff).cast("timestamp")).orderBy(at, id_col).limit(batch)


def metrics(queue: DataFrame) -> DataFrame:
    """Counts by status and the failure rate among finished items."""
    done = F.col("status").isin("resolved", "failed")
    return queue.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "resolved", "failed")),
        F.try_divide(F.count_if(F.col("status") == "failed"), F.count_if(done)).alias("failure_rate"),
    )
