"""Candidates for the product catalog: gathered from listings, scored, refreshed, picked; and what the catalog gives back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["manufacturer_id", "normalized_model"]


def priority(unclassified: Column, other: Column, unresolved: Column, shops: Column, listings: Column) -> Column:
    return unclassified * 100 + other * 80 + unresolved * 40 + shops * 10 + F.least(listings, F.lit(9))


def _first_seen(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Each key's first n distinct values by listing, sorted. A value is one row before it meets the others of its key."""
    text = F.trim(F.coalesce(value, F.lit("")))
    seen = rows.withColumn("_v", text).where("_v <> ''").groupBy(*KEY, "_v").agg(F.min("listing_id").alias("_id"))
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("_id", "_v"))).where(F.col("_n") <= n)
    return first.groupBy(*KEY).agg(F.sort_array(F.collect_list("_v")).alias(value))


def candidates(listings: DataFrame, variants: int = 10, urls: int = 5) -> DataFrame:
    """listings: listing_id, shop_key, manufacturer_id, normalized_model, manufacturer, model, raw_model, title, source_url,
    category_ids, classification_status, identity_status, identity_method, first_seen_at, last_seen_at (active ones).

    A row for each maker and model: names of the first listing, title of the last unclassified one (else the first), counts,
    categories, the first spellings and addresses, the reason most often given for a missing identity (ties by name), score.
    """
    rows = listings.withColumns({"manufacturer_id": F.lower(F.trim("manufacturer_id")), "normalized_model": F.trim("normalized_model")})
    rows = rows.where("manufacturer_id <> '' AND normalized_model <> ''")
    loose = F.coalesce("classification_status", F.lit("")) != "classified"
    unmatched = F.coalesce("identity_status", F.lit("")) != "matched"
    titled = loose & (F.coalesce("title", F.lit("")) != "")
    out = rows.groupBy(*KEY).agg(
        F.min_by("manufacturer", "listing_id").alias("observed_manufacturer"), F.min_by("model", "listing_id").alias("observed_model"),
        F.coalesce(F.max_by(F.when(titled, F.trim("title")), F.when(titled, F.col("listing_id"))), F.min_by(F.trim("title"), "listing_id")).alias("sample_title"),
        F.count("*").alias("listings"), F.count_distinct("shop_key").alias("shops"), F.count_if(loose).alias("unclassified"),
        F.count_if(~loose & F.coalesce(F.array_contains("category_ids", "other"), F.lit(False))).alias("other"), F.count_if(unmatched).alias("unresolved"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    kinds = rows.select(*KEY, F.explode("category_ids").alias("c")).distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("c")).alias("category_ids"))
    method = F.trim(F.coalesce("identity_method", F.lit("")))
    why = rows.where(unmatched).groupBy(*KEY, F.when(method == "", "missing_resolution").otherwise(method).alias("r")).agg(F.count("*").alias("n"))
    why = why.groupBy(*KEY).agg(F.min(F.struct((-F.col("n")).alias("n"), "r")).alias("w")).select(*KEY, F.col("w.r").alias("reason"))
    for part in (kinds, _first_seen(rows, "raw_model", variants), _first_seen(rows, "source_url", urls), why):
        out = out.join(part, KEY, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("category_ids", "raw_model", "source_url")} | {"reason": F.coalesce("reason", F.lit(""))})
    return out.withColumn("priority", priority(*(F.col(c) for c in ("unclassified", "other", "unresolved", "shops", "listings"))))


def refresh(stored: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Stored candidates after a new gathering. stored and found: key, listings, priority, first_seen_at; stored also review_status.

    Who has a catalog product is matched, the ignored stay ignored, others are pending; who is gone keeps the status with
    zero counts. The first sighting stays. matches: key, catalog_product_id.
    """
    old = stored.select(*KEY, "review_status", F.col("catalog_product_id").alias("_old_product"), F.col("first_seen_at").alias("_first"))
    rows = found.join(matches, KEY, "left").withColumn("_here", F.lit(True)).join(old, KEY, "full")
    here = F.coalesce("_here", F.lit(False))
    status = F.when(~here, F.col("review_status")).when(F.col("catalog_product_id").isNotNull(), "matched").when(F.col("review_status") == "ignored", "ignored").otherwise("pending")
    return rows.select(
        *KEY, F.coalesce("listings", F.lit(0)).cast("long").alias("listings"), F.coalesce("priority", F.lit(0)).cast("long").alias("priority"), status.alias("review_status"),
        F.when(here, F.col("catalog_product_id")).otherwise(F.col("_old_product")).alias("catalog_product_id"), F.coalesce("_first", "first_seen_at").alias("first_seen_at"),
    )


def stats(rows: DataFrame) -> DataFrame:
    """Counts of the candidates that still have listings."""
    live = rows.where("listings > 0")
    return live.agg(F.count("*").alias("candidates"), *(F.count_if(F.col("review_status") == s).alias(s) for s in ("pending", "matched", "ignored")))


def pending(rows: DataFrame, n: int, makers: list[str] | None = None, retries_first: bool = False) -> DataFrame:
    """The next candidates to verify: never tried ones first (or, the other way round, the latest tries first), then by score."""
    rows = rows.where("review_status = 'pending' AND listings > 0")
    if makers is not None:
        rows = rows.where(F.col("manufacturer_id").isin([m.strip().lower() for m in makers if m.strip()]))
    tried = F.col("tried_at").isNotNull().cast("int")
    order = [F.desc(tried), F.desc_nulls_last("tried_at")] if retries_first else [F.asc(tried), F.asc_nulls_first("tried_at")]
    return rows.orderBy(*order, F.desc("priority"), F.desc("unclassified"), F.desc("shops"), F.desc("listings"), "id").limit(n)


def due(products: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Verified products whose last verification is missing or older than this, and that aren't marked yet."""
    old = F.col("last_verified_at").isNull() | (F.col("last_verified_at") <= F.timestamp_seconds(F.lit(now).cast("timestamp").cast("long") - max(1, days) * 86400))
    return products.where((F.col("verification_status") == "verified") & (F.col("review_status") != "due") & old)


def reclassify(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Matched listings whose category differs from their product's: (listing_id, category_id, new_category_id)."""
    new = products.where("verification_status = 'verified'").select("catalog_product_id", F.col("category_id").alias("new_category_id"))
    rows = listings.where("identity_status = 'matched'").join(new, "catalog_product_id")
    return rows.where(~F.col("category_id").eqNullSafe(F.col("new_category_id"))).select("listing_id", "category_id", "new_category_id")
