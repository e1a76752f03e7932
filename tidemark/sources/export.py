"""A resumable CSV export in chunks: chunks are pages of rows in key order, found by counts over sorted ranges, written once each.

The first run fixes the export: its horizon (the largest key) and, for each chunk, the keys that it holds. A run writes chunks in
parts and skips those that are there, so a restart neither repeats nor moves a row, whatever has come to the table since. Parts that
follow each other are written by one job, in few jobs a run, as each reads the table; a restart repeats the job that broke off.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.sources import csv_sink
from tidemark.sources.shared import exists, finished

PAGE, PART = 250, 64
#: Jobs that write all parts of a run, and chunks of which a job holds the first and last keys at most.
JOBS, HELD = 8, 65_536


def chunks(rows: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """rows with chunk, their page in key order from 0. key tells all rows apart. Only counts by range are gathered, not rows."""
    placed = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", (before - F.col("_first")).alias("_shift"))  # a row for each range
    return placed.join(counts, "_range").withColumn("chunk", F.floor((F.col("_at") + F.col("_shift")) / page).cast("long")).drop("_at", "_range", "_shift")


def plan(rows: DataFrame, path: str, key: str, page: int = PAGE) -> DataFrame:
    """(chunk, first_key, last_key, row_count) of the export at path, made by its first run and read by later ones."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/plan/_SUCCESS"):
        keys = rows.select(key).where(F.col(key).isNotNull())
        keys.write.mode("overwrite").parquet(f"{path}/keys")  # sorting reads twice, and has to read the same
        made = chunks(spark.read.parquet(f"{path}/keys"), key, page).groupBy("chunk").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("row_count"))
        made.write.mode("overwrite").parquet(f"{path}/plan")
    return spark.read.parquet(f"{path}/plan")


def _written(path: str, spark) -> list[tuple[int, int]]:
    """Parts that are written, as (first, last)."""
    return [tuple(map(int, name.split("-"))) for name in finished(spark, f"{path}/chunks")]


def _jobs(todo: list[int], part: int) -> list[tuple[int, int]]:
    """Runs of parts without a gap, for one job each."""
    most, out = max(1, min(-(-len(todo) // JOBS), HELD // part)), []
    for p in todo:
        if out and out[-1][1] == p - 1 and p - out[-1][0] < most:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _chunk_of(planned: DataFrame):
    """A function of a key: the chunk whose keys it lies between, null if there is none."""
    first, last, chunk = (c.to_pylist() for c in planned.select("first_key", "last_key", "chunk").orderBy("chunk").toArrow().columns)

    @F.arrow_udf(LongType())
    def found(keys: pa.Array) -> pa.Array:
        at = [(k, bisect_right(first, k) - 1) for k in keys.to_pylist()]
        return pa.array([chunk[i] if i >= 0 and k <= last[i] else None for k, i in at], pa.int64())

    return found


def export(rows: DataFrame, path: str, key: str, page: int = PAGE, part: int = PART, budget: int = 4096, most_parts: int | None = None) -> DataFrame:
    """(chunk, object_key, first_key, last_key, row_count, body) of all chunks that are written; bodies are CSV in the dialect of csv_sink, in
    key order, the header in chunk 0 only, which is there even without rows. most_parts: parts that this run writes at most, as a worker's turn.

    Rows without a key, and rows beyond the horizon, are not exported. Rows of a chunk that were deleted before it is written are missing in it; its place stays.
    """
    spark = rows.sparkSession
    planned = plan(rows, path, key, page)
    last = planned.agg(F.max("chunk")).first()[0]
    parts = 1 if last is None else last // part + 1
    head = csv_sink.header(rows) + "\r\n"
    job = path.rsplit("/", 1)[-1]
    there = {p for a, b in _written(path, spark) for p in range(a, b + 1)}
    todo = [p for p in range(parts) if p not in there][:most_parts]
    for a, b in _jobs(todo, part):
        mine = planned.where((F.col("chunk") >= a * part) & (F.col("chunk") < (b + 1) * part))
        if last is None:
            kind = planned.schema["first_key"].dataType
            out = spark.range(1).select(F.lit(0).cast("long").alias("chunk"), F.lit(None).cast(kind).alias("first_key"), F.lit(None).cast(kind).alias("last_key"), F.lit(0).cast("long").alias("row_count"), F.lit("").alias("_text"))
        else:
            low, high = mine.agg(F.min("first_key"), F.max("last_key")).first()
            some = rows.where(F.col(key).between(low, high))
            lines = csv_sink.lines(some, [key], budget).withColumn("chunk", _chunk_of(mine)(F.col(key))).where("chunk IS NOT NULL")
            # a chunk is a page of rows
            bodies = lines.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(key, "line"))).alias("x"))
            text = F.array_join(F.transform("x", lambda x: F.concat(x.line, F.lit("\r\n"))), "")
            out = mine.join(bodies.select("chunk", text.alias("_text")), "chunk", "left")
        body = F.concat(F.when(F.col("chunk") == 0, head).otherwise(""), F.coalesce("_text", F.lit("")))
        name = F.concat(F.lit(f"exports/{job}/"), F.lpad(F.col("chunk").cast("string"), 8, "0"), F.lit(".csv"))
        out.select("chunk", name.alias("object_key"), "first_key", "last_key", "row_count", body.alias("body")).write.mode("overwrite").parquet(f"{path}/chunks/{a}-{b}")
    return _read(path, spark)


def _read(path: str, spark) -> DataFrame:
    """All chunks that are written; not what a job left that broke off."""
    return spark.read.parquet(*(f"{path}/chunks/{a}-{b}" for a, b in _written(path, spark)))


def complete(path: str, spark) -> bool:
    """Whether every chunk of the plan is written."""
    if not exists(spark, f"{path}/plan/_SUCCESS") or not _written(path, spark):
        return False
    planned = spark.read.parquet(f"{path}/plan")
    return planned.join(_read(path, spark).select("chunk"), "chunk", "left_anti").count() == 0
