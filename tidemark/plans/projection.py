"""The search read model on the driver's tables: rebuilt as a whole, and repaired after damage; each query with its DuckDB SQL.

A line item is a listing (its price is part of its id, as two line items share a key); a brand and a number are its exact identity; every fifth part is a product of the catalog.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import projection
from tidemark.sources.shared import new_folder, written

from .listings import _t, offers
from .oracles import _OFFERS

#: Listings are active below this price; before the damage, below the higher one.
ACTIVE, BEFORE = 50_000, 60_000


def _model(spark, d, active=ACTIVE):
    p = _t(spark, d, "part")
    number = F.col("p_partkey") % 500
    category = F.when(F.col("p_size") % 10 == 0, "dac").when(F.col("p_size") % 10 < 3, "other").otherwise("rack")
    listings = offers(spark, d).join(p, F.col("entity_id") == F.col("p_partkey")).select(
        F.concat_ws("-", "listing_id", F.col("price_yen").cast("string")).alias("listing_id"), "shop_key", F.lower("p_brand").alias("manufacturer_id"), F.when(F.col("price_yen") % 4 > 0, F.col("p_brand")).otherwise("").alias("manufacturer"),
        F.upper("p_brand").alias("raw_manufacturer"), F.concat(F.lit("AX-"), number.cast("string")).alias("model"), F.when(F.col("stock_status") == "unknown", "candidate").otherwise("resolved").alias("model_status"),
        F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.lower("p_type").alias("raw_category"), category.alias("primary_category_id"), F.lit(None).cast("string").alias("search_aliases"),
        (F.col("price_yen") < active).alias("is_active"), "stock_status", "price_yen", "previous_price_yen", "first_seen_at", "source_published_at", "last_activity_at", "entity_id",
    )
    products = p.where("p_partkey % 5 = 0")
    made = products.select(F.col("p_partkey").alias("catalog_product_id"), F.lower("p_brand").alias("manufacturer_id"), F.concat_ws(" ", F.lit("PX"), F.col("p_partkey").cast("string")).alias("canonical_model"), F.when(F.col("p_size") > 10, "verified").otherwise("pending").alias("verification_status"))
    kinds = products.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("catalog_product_id"), F.explode(F.array(F.lit("dac"), F.lit("rack"))).alias("category_id"), "p_size")
    kinds = kinds.select("catalog_product_id", "category_id", ((F.col("category_id") == "rack") & (F.col("p_size") % 2 == 0)).alias("is_primary"))
    names = products.where("p_size > 30").select(F.col("p_partkey").alias("catalog_product_id"), F.col("p_name").alias("alias"))
    makers = p.select(F.lower("p_brand").alias("manufacturer_id"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("alias")).distinct()
    hit = F.col("entity_id").isNotNull() & (F.col("entity_id") % 5 == 0) & (F.col("price_yen") % 3 > 0)
    identities = listings.select("listing_id", F.when(hit, "matched").otherwise("unresolved").alias("status"), F.when(hit, F.col("entity_id")).alias("catalog_product_id"))
    return projection.Model(listings.drop("entity_id"), identities, made, kinds, names, makers)


def _shown(entities):
    return entities.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("latest_activity_at", "newest_listed_at")})


def read_model_rebuild(spark, d):
    """All entities with what they are, what their offers sum up to and what text search finds them by."""
    return _shown(projection.rebuild(_model(spark, d), new_folder(spark, "rebuild")).entities)


def read_model_repair(spark, d):
    """The same after a repair: some listings went, others lost their identity or offer, entities are lost, left over or miscounted."""
    path = new_folder(spark, "damaged")
    whole = _model(spark, d)
    # what a sync reads again and again is stored, not joined from the driver's tables each time
    whole = replace(whole, listings=written(whole.listings, f"{path}/listings"), identities=written(whole.identities, f"{path}/known"))
    m = projection.rebuild(replace(whole, listings=whole.listings.withColumn("is_active", F.col("price_yen") < BEFORE)), new_folder(spark, "rebuild"))
    h = F.pmod(F.crc32(F.col("listing_id").cast("binary")), F.lit(97))
    e = F.pmod(F.crc32(F.col("entity_key").cast("binary")), F.lit(97))
    kept = m.entities.where(e > 3).withColumn("offer_count", F.col("offer_count") + F.when(e == 50, 1).otherwise(0))
    more = kept.where(e == 60).withColumn("entity_key", F.concat("entity_key", F.lit("-left")))
    m = replace(
        m, listings=whole.listings, identities=written(m.identities.where(h > 2), f"{path}/identities"), offers=written(m.offers.where((h < 40) | (h > 42)), f"{path}/offers"), entities=written(kept.unionByName(more), f"{path}/entities"),
    )
    m, _ = projection.repair(m, lambda lost: whole.identities.join(lost.select("listing_id"), "listing_id", "left_semi"))
    return _shown(m.entities)


def read_model_drift(spark, d):
    """Entities and listings that no longer follow, after listings went and products lost their status."""
    m = projection.rebuild(_model(spark, d, BEFORE), new_folder(spark, "rebuild"))
    catalog = m.catalog.withColumn("verification_status", F.when(F.col("catalog_product_id") % 3 == 0, "rejected").otherwise(F.col("verification_status")))
    m = replace(m, listings=_model(spark, d).listings, catalog=catalog)
    return projection.drift(m).groupBy("problem").agg(F.count("*").alias("n"))


def _sql(active: int) -> str:
    """CTEs l (listings), b (listing, entity), e (entities), as rebuild gives them below a price."""
    return f"""{_OFFERS}, l AS (
    SELECT listing_id || '-' || price_yen AS listing_id, shop_key, lower(p_brand) AS maker, CASE WHEN price_yen % 4 > 0 THEN p_brand ELSE '' END AS shown, p_brand, 'AX-' || (p_partkey % 500) AS model, 'AX' || (p_partkey % 500) AS normal,
      stock_status <> 'unknown' AS resolved, p_name, p_type, CASE WHEN p_size % 10 = 0 THEN 'dac' WHEN p_size % 10 < 3 THEN 'other' ELSE 'rack' END AS category, price_yen, previous_price_yen, stock_status, seen_at,
      p_partkey, p_partkey % 5 = 0 AND p_size > 10 AND price_yen % 3 > 0 AS matched
    FROM offers JOIN part ON entity_id = p_partkey WHERE price_yen < {active}
  ), g AS (
    SELECT maker, normal, min(listing_id) AS leader FROM l WHERE resolved AND NOT matched GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN category <> 'other' THEN category END) <= 1
  ), b AS (
    SELECT l.*, CASE WHEN matched THEN 'c-' || p_partkey ELSE 'l-' || coalesce(CASE WHEN resolved THEN leader END, listing_id) END AS entity_key,
      concat_ws(' ', maker, CASE WHEN shown <> '' THEN shown END, upper(p_brand), 'B' || substr(p_brand, 7)) AS maker_terms FROM l LEFT JOIN g USING (maker, normal)
  ), s AS (
    SELECT entity_key, min(nullif(shown, '')) AS display, count(*) AS offer_count, count(*) FILTER (WHERE stock_status = 'in_stock') AS in_stock_offer_count, count(*) FILTER (WHERE stock_status = 'sold_out') AS sold_out_offer_count,
      count(DISTINCT shop_key) AS shop_count, min(price_yen) AS lowest_price_yen, min(price_yen) FILTER (WHERE stock_status = 'in_stock') AS lowest_in_stock_price_yen, max(price_yen) AS highest_price_yen,
      strftime(max(seen_at), '%Y-%m-%d') AS latest_activity_at, strftime(max(seen_at), '%Y-%m-%d') AS newest_listed_at, CAST(coalesce(bool_or(price_yen < previous_price_yen), false) AS INTEGER) AS has_price_drop
    FROM b GROUP BY 1
  ), n AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY listing_id) AS k FROM b
  ), t AS (SELECT entity_key, string_agg(p_name || ' ' || maker_terms || ' ' || model || ' ' || normal, ' ' ORDER BY k) AS title_terms, string_agg(p_type || ' ' || lower(p_type), ' ' ORDER BY k) AS category_terms FROM n WHERE k <= 3 GROUP BY 1
  ), e AS (
    SELECT s.* EXCLUDE (display), t.title_terms, t.category_terms, CASE WHEN p.p_partkey IS NULL THEN 'unresolved_listing' ELSE 'catalog' END AS entity_kind, coalesce(lower(p.p_brand), f.maker) AS manufacturer_id,
      coalesce(display, f.shown, '') AS manufacturer, coalesce('PX ' || p.p_partkey, f.model) AS model, coalesce('PX' || p.p_partkey, f.normal) AS normalized_model,
      CASE WHEN p.p_partkey IS NULL THEN f.category WHEN p.p_partkey % 10 > 0 THEN 'unclassified' WHEN p.p_size % 2 = 0 THEN 'rack' ELSE 'dac' END AS primary_category_id,
      coalesce(lower(p.p_brand), f.maker_terms) AS manufacturer_terms, CASE WHEN p.p_partkey IS NULL THEN f.model || ' ' || f.normal ELSE 'PX ' || p.p_partkey || ' PX' || p.p_partkey || CASE WHEN p.p_size > 30 THEN ' ' || p.p_name ELSE '' END END AS model_terms
    FROM s JOIN t USING (entity_key) LEFT JOIN part AS p ON s.entity_key = 'c-' || p.p_partkey LEFT JOIN b AS f ON s.entity_key = 'l-' || f.listing_id
  )"""


_DRIFT = f"""WITH {_sql(BEFORE)}, o AS (
    SELECT entity_key, 'listing' AS kind, count(*) AS n FROM b WHERE price_yen >= {ACTIVE} GROUP BY 1
  ) SELECT 'inactive_offer_memberships' AS problem, CAST(sum(n) AS BIGINT) AS n FROM o UNION ALL SELECT 'offer_count_mismatches', count(*) FROM o
  UNION ALL SELECT 'ineligible_catalog_entities', count(*) FROM e JOIN part ON entity_key = 'c-' || p_partkey WHERE p_partkey % 3 = 0"""

QUERIES = {f.__name__: f for f in (read_model_rebuild, read_model_repair, read_model_drift)}
ORACLES = {"read_model_rebuild": f"WITH {_sql(ACTIVE)} SELECT * FROM e", "read_model_repair": f"WITH {_sql(ACTIVE)} SELECT * FROM e", "read_model_drift": _DRIFT}
