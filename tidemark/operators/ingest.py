"""State transitions of listings: one batch of observations folded into the known state, as pure functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["shop_key", "source_id"]


def changed(old: str, new: str, fields: list[str]) -> Column:
    """True if any field differs; null equals null."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}"))
    return out


def fold(state: DataFrame, batch: DataFrame, now: str, complete: bool, touch_minutes: int = 360, fields: tuple[str, ...] = ("title", "price_yen", "stock_status")) -> DataFrame:
    """The next state with an action for each key: insert, update, touch, none or deactivate.

    state: key, fields, previous_price_yen, first_seen_at, last_seen_at, is_active. batch: key, fields; of several rows of a
    key the best-informed one counts (known stock, then price, then longer title). Unseen listings are deactivated only if
    the batch is complete. previous_price_yen takes the old price when a new, non-null one replaces it.
    """
    order = Window.partitionBy(*KEY).orderBy(F.desc((F.col("stock_status") != "unknown").cast("int")), F.col("price_yen").isNull(), F.desc(F.length("title")), *fields)
    new = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*KEY, *fields)
    s, b = state.alias("s"), new.alias("b")
    rows = s.join(b, [F.col(f"s.{k}") == F.col(f"b.{k}") for k in KEY], "full")
    at = F.lit(now).cast("timestamp")
    seen, known = F.col("b.source_id").isNotNull(), F.col("s.source_id").isNotNull()
    old = at - F.expr(f"INTERVAL {touch_minutes} MINUTES")
    action = (
        F.when(~known, "insert")
        .when(seen & (changed("s", "b", list(fields)) | ~F.col("s.is_active")), "update")
        .when(seen & (F.col("s.last_seen_at") <= old), "touch")
        .when(~seen & F.col("s.is_active") & F.lit(complete), "deactivate")
        .otherwise("none")
    )
    rows = rows.withColumn("action", action)
    write = F.col("action").isin("insert", "update")
    priced = write & F.col("b.price_yen").isNotNull() & ~F.col("b.price_yen").eqNullSafe(F.col("s.price_yen"))
    return rows.select(
        *(F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in KEY),
        *(F.when(write, F.col(f"b.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields),
        F.when(priced & known, F.col("s.price_yen")).otherwise(F.col("s.previous_price_yen")).alias("previous_price_yen"),
        F.coalesce("s.first_seen_at", at).alias("first_seen_at"),
        F.when(F.col("action").isin("insert", "update", "touch"), at).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(F.col("action") == "deactivate", False).when(seen, True).otherwise(F.col("s.is_active")).alias("is_active"),
        "action", priced.alias("price_changed"),
    )


def price_history(folded: DataFrame, now: str) -> DataFrame:
    """What a fold appends to the price history."""
    return folded.where("price_changed").select(*KEY, "price_yen", F.lit(now).cast("timestamp").alias("observed_at"))


def user_facing(old: str, new: str) -> Column:
    """A change that counts as activity: title, price, or stock between known states."""
    stock = (F.col(f"{old}.stock_status") != F.col(f"{new}.stock_status")) & (F.col(f"{old}.stock_status") != "unknown") & (F.col(f"{new}.stock_status") != "unknown")
    return changed(old, new, ["title", "price_yen"]) | F.coalesce(stock, F.lit(False))


def activity_time(published: Column, first_seen: Column, now: Column) -> Column:
    """A listing published over 48 hours before it was first seen is dated by its source."""
    return F.when(published < first_seen - F.expr("INTERVAL 48 HOURS"), published).otherwise(now)


def quotas(objects: DataFrame, per_day: int, per_shop_day: int, burst: int, burst_seconds: int = 900) -> DataFrame:
    """objects (shop_key, at, bytes, content_hash) with accepted: the first of each hash, within quotas counted over what came
    before, by time then hash. Counts are of objects offered; the streaming form counts those accepted."""
    first = Window.partitionBy("content_hash").orderBy("at", "shop_key")
    rows = objects.withColumn("_dup", F.row_number().over(first) > 1).withColumn("_day", F.to_date("at")).withColumn("_t", F.col("at").cast("timestamp").cast("long"))
    new = F.when(~F.col("_dup"), 1).otherwise(0)
    # a day is counted by minutes: sums of those before, and an order only within a minute, so no task holds a whole day
    rows = rows.withColumn("_minute", F.floor(F.col("_t") / 60))
    minutes = rows.groupBy("_day", "_minute").agg(F.sum(new).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(minutes.select("_day", "_minute", before.alias("_before")), ["_day", "_minute"], "left")
    day = Window.partitionBy("_day", "_minute").orderBy("at", "content_hash", "shop_key").rowsBetween(Window.unboundedPreceding, -1)
    shop = Window.partitionBy("shop_key", "_day").orderBy("at", "content_hash").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("shop_key").orderBy("_t").rangeBetween(-burst_seconds, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = ~F.col("_dup") & (zero("_before") + zero(F.sum(new).over(day)) < per_day) & (zero(F.sum(new).over(shop)) < per_shop_day) & (F.sum(new).over(near) <= burst)
    return rows.withColumn("accepted", ok).select(*objects.columns, "accepted")
