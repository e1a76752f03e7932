"""Data quality: counters of a shop, rates, levels, trends, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(count: Column, total: Column) -> Column:
    """A share; null, never 0 or 1, when there is nothing to divide by."""
    return F.try_divide(count.cast("double"), total.cast("double"))


def level(value: Column, warning: float, critical: float, high_is_bad: bool = True) -> Column:
    """unknown, healthy, warning or critical; thresholds are part of the worse level."""
    if high_is_bad:
        return F.when(value.isNull(), "unknown").when(value >= critical, "critical").when(value >= warning, "warning").otherwise("healthy")
    return F.when(value.isNull(), "unknown").when(value <= critical, "critical").when(value <= warning, "warning").otherwise("healthy")


_RANK = {"unknown": 0, "healthy": 1, "warning": 2, "critical": 3}


def worst(*levels: Column) -> Column:
    """The worst of several levels; unknown only if all are."""
    ranks = [F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in _RANK.items())) for c in levels]
    top = F.greatest(*ranks, F.lit(0)) if ranks else F.lit(0)
    return F.element_at(F.array(*(F.lit(k) for k in _RANK)), top + 1)


def snapshot(listings: DataFrame, identities: DataFrame) -> DataFrame:
    """Counters of each shop's active listings; a listing without an identity row counts as unresolved."""
    rows = listings.where("is_active").join(identities.select("listing_id", "status"), "listing_id", "left")
    return rows.groupBy("shop_key").agg(
        F.count("*").alias("total_items"),
        F.count_if(F.coalesce("manufacturer", F.lit("")) == "").alias("manufacturer_missing"),
        F.count_if(F.col("category") == "unclassified").alias("category_unclassified"),
        F.count_if(F.col("status") == "matched").alias("identity_matched"),
        F.count_if(F.coalesce(F.col("status"), F.lit("unresolved")) != "matched").alias("identity_unresolved"),
        F.count_if(F.col("stock_status") == "unknown").alias("inventory_unknown"),
    )


def latest(runs: DataFrame, key: str, at: str, id_col: str, linked: str) -> DataFrame:
    """The latest row of each key, and the latest that has a linked run, as two ids: one pass."""
    order = F.struct(F.col(at).isNotNull(), at, id_col)
    return runs.groupBy(key).agg(F.max_by(id_col, order).alias("latest_id"), F.max_by(F.when(F.col(linked), F.col(id_col)), F.when(F.col(linked), order)).alias("latest_linked_id"))


def trend(metrics: DataFrame, key: str, at: str, value: str, points: int = 12) -> DataFrame:
    """Each key's last value, the one before, the difference, and its last points from old to new."""
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    rows = metrics.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= points)
    history = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))), lambda x: x.v)
    out = rows.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("value"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("previous"), history.alias("history"))
    delta = F.col("value") - F.col("previous")
    return out.withColumns({"delta": delta, "direction": F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat").otherwise("unknown")})


def health(shops: DataFrame, now: str, interval_minutes: int, factor: int = 3) -> DataFrame:
    """shops: shop_key, last_success_at, consecutive_failures. critical: never succeeded or 3 failures; warning: stale."""
    age = (F.lit(now).cast("timestamp").cast("long") - F.col("last_success_at").cast("long")) / 60
    state = F.when(F.col("last_success_at").isNull() | (F.col("consecutive_failures") >= 3), "critical").when(age > interval_minutes * factor, "warning").otherwise("healthy")
    return shops.withColumns({"age_minutes": F.floor(age), "state": state})


def item_drop(current: Column, previous: Column, ratio: float = 0.5, baseline: int = 20) -> Column:
    """A suspicious fall of a crawl's item count."""
    return F.coalesce((previous >= baseline) & (current < previous * ratio), F.lit(False))
