"""Entities from listings: membership, aggregates, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregate(offers: DataFrame, *more: Column) -> DataFrame:
    """One row an entity: counts, shops, prices, activity, and more aggregates. Summed before it is shuffled."""
    price, stock = F.col("price_yen"), F.col("stock_status")
    return offers.groupBy("entity_id").agg(
        F.count("*").alias("offer_count"),
        F.count_if(stock == "in_stock").alias("in_stock_offer_count"),
        F.count_if(stock == "sold_out").alias("sold_out_offer_count"),
        F.count_distinct("shop_key").alias("shop_count"),
        F.min(price).alias("lowest_price_yen"),
        F.min(F.when(stock == "in_stock", price)).alias("lowest_in_stock_price_yen"),
        F.max(price).alias("highest_price_yen"),
        F.max("last_activity_at").alias("latest_activity_at"),
        F.max(F.coalesce("source_published_at", "first_seen_at")).alias("newest_listed_at"),
        F.coalesce(F.bool_or(price < F.col("previous_price_yen")), F.lit(False)).cast("int").alias("has_price_drop"),
        *more,
    )


def exact_groups(listings: DataFrame) -> DataFrame:
    """(manufacturer, model, entity_id): resolved listings of one manufacturer and model, led by the smallest id, unless
    they name more than one specific category (`other` and `unclassified` name none)."""
    specific = F.when(~F.col("category").isin("other", "unclassified"), F.col("category"))
    groups = listings.where("model_status = 'resolved' AND manufacturer <> '' AND model <> ''").groupBy("manufacturer", "model")
    groups = groups.agg(F.min("listing_id").alias("entity_id"), F.count_distinct(specific).alias("_c"))
    return groups.where("_c <= 1").drop("_c")


def matched(identities: DataFrame, catalog: DataFrame) -> DataFrame:
    """(listing_id, catalog_product_id) of identities matched to verified products."""
    verified = catalog.where("verification_status = 'verified'").select("catalog_product_id")
    return identities.where("status = 'matched'").select("listing_id", "catalog_product_id").join(verified, "catalog_product_id", "left_semi")


def keyed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (listing_id, manufacturer, model, model_status, catalog_product_id) with entity_key, and alone: whether no other listing can be in it."""
    rows = rows.join(groups.withColumnRenamed("entity_id", "_leader"), ["manufacturer", "model"], "left")
    led = F.when(F.col("model_status") == "resolved", F.col("_leader"))
    key = F.when(F.col("catalog_product_id").isNotNull(), F.concat(F.lit("c-"), F.col("catalog_product_id").cast("string"))).otherwise(
        F.concat(F.lit("l-"), F.coalesce(led, F.col("listing_id")).cast("string"))
    )
    return rows.withColumns({"entity_key": key, "alone": F.col("catalog_product_id").isNull() & led.isNull()}).drop("_leader")


def build(listings: DataFrame, identities: DataFrame, catalog: DataFrame, *kept: str) -> DataFrame:
    """(listing_id, kept columns, entity_key): each active listing in exactly one entity.

    c-<product> if its identity is matched to a verified product; else l-<id> of its exact group's leader; else l-<its id>.
    """
    rows = listings.where("is_active").join(matched(identities, catalog), "listing_id", "left")
    return keyed(rows, exact_groups(rows.where("catalog_product_id IS NULL"))).select("listing_id", *kept, "entity_key")


def first_terms(offers: DataFrame, text: str, n: int = 3) -> DataFrame:
    """(entity_id, terms): the texts of an entity's first n listings by id, joined by spaces."""
    order = Window.partitionBy("entity_id").orderBy("listing_id")
    some = offers.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda x: x.t), " ")
    return some.groupBy("entity_id").agg(joined.alias("terms"))


def split_groups(listings: DataFrame) -> DataFrame:
    """Groups of manufacturer and model that stand in more than one entity."""
    return listings.groupBy("manufacturer", "model").agg(F.count("*").alias("listings"), F.count_distinct("entity_id").alias("entities")).where("listings > 1 AND entities > 1")


def consistency(entities: DataFrame, offers: DataFrame, listings: DataFrame) -> DataFrame:
    """One row of drift counters; all 0 if the read model follows from the listings."""
    counts = offers.groupBy("entity_id").agg(F.count("*").alias("n"))
    return (
        entities.join(offers.select("entity_id").distinct(), "entity_id", "left_anti").agg(F.count("*").alias("empty_entities"))
        .crossJoin(offers.join(entities, "entity_id", "left_anti").agg(F.count("*").alias("orphan_offers")))
        .crossJoin(listings.where("is_active").join(offers, "listing_id", "left_anti").agg(F.count("*").alias("missing_offers")))
        .crossJoin(entities.join(counts, "entity_id").where("n <> offer_count").agg(F.count("*").alias("wrong_counts")))
    )  # four tables of one row each


def refresh(before: DataFrame, after: DataFrame, entities: DataFrame, offers: DataFrame) -> DataFrame:
    """Entities after a change: those touched before or after it are computed anew, the others kept."""
    touched = before.select("entity_id").unionByName(after.select("entity_id")).distinct()
    return entities.join(touched, "entity_id", "left_anti").unionByName(aggregate(offers.join(touched, "entity_id", "left_semi")))
