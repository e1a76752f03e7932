"""Matches with the catalog on the driver's tables, with their DuckDB SQL: a part is a product, a line item a listing of it in some spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog_match

from .listings import _t


def _tables(spark, d):
    p = _t(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    maker = F.when(k % 3 == 0, "denon").when(k % 3 == 1, "marantz").otherwise(F.lower("p_brand"))
    model = F.when(k % 3 == 0, F.concat(F.lit("PMA-"), n)).when(k % 3 == 1, F.concat(F.lit("SACD "), n)).otherwise(F.concat(F.lit("AX-"), n))
    own = p.select(k.alias("product_id"), maker.alias("manufacturer_id"), model.alias("canonical_model"), F.upper(model).alias("normalized_model"), F.when(F.col("p_size") > 5, "verified").otherwise("pending").alias("verification_status"))
    # some names are claimed twice: as the name, or as the alias, of another product
    twin = own.where("product_id % 40 = 0").withColumn("product_id", F.col("product_id") + 10_000_000)
    products = own.unionByName(twin)
    aliases = own.select("product_id", F.concat(F.lit("Q-"), F.col("product_id").cast("string")).alias("alias"))
    aliases = aliases.unionByName(own.where("product_id % 40 = 11").select((F.col("product_id") + 3).alias("product_id"), F.col("canonical_model").alias("alias")))
    kinds = products.select("product_id", F.explode(F.array(F.lit("dac"), F.lit("rack"))).alias("category_id")).where("product_id % 7 > 0")
    kinds = kinds.withColumn("is_primary", F.col("category_id") == F.when(F.col("product_id") % 2 == 0, "rack").otherwise("dac"))
    line = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == k).withColumns({"maker": maker, "model": model})
    i = F.col("l_linenumber")
    spelled = (
        F.when(i == 1, F.concat(F.lit(" "), F.lower("model"), F.lit(" "))).when(i == 2, F.concat(F.lit("《限定》"), "model", F.lit("【SOLD OUT】"))).when(i == 3, F.concat("model", F.lit(" / シルバー（ペア）")))
        .when(i == 4, F.concat("model", F.when(k % 3 == 0, "-SP").when(k % 3 == 1, "/FB").otherwise("-SP"))).when(i == 5, F.concat(F.lit("q - "), n)).when(i == 6, F.concat(F.replace("model", F.lit(" "), F.lit("")), F.lit("+AD-290V")))
        .otherwise(F.col("model"))
    )
    key = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    status = F.when((i == 7) | (F.col("l_quantity") > 45), "candidate").when(i == 1, "").otherwise("resolved")
    return line.select(key.alias("listing_id"), F.upper("maker").alias("manufacturer_id"), spelled.alias("model"), status.alias("model_status")), products, aliases, kinds


def catalog_matches(spark, d):
    """Listings and the products that they name, with how."""
    out = catalog_match.matches(*_tables(spark, d))
    return out.select("listing_id", "product_id", "match_type", "matched_name", F.array_join("category_ids", ",").alias("category_ids"))


def manual_categories(spark, d):
    """Categories by hand for listings whose model isn't resolved."""
    listings, products, aliases, kinds = _tables(spark, d)
    sources = products.select("product_id", F.when(F.col("product_id") % 4 < 3, "manual_verified").otherwise("official").alias("source_type"), F.when(F.col("product_id") % 5 > 0, "active").otherwise("gone").alias("status"))
    return catalog_match.manual_matches(listings, products, aliases, kinds, sources)


_LINES = """l AS (
    SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(l_linenumber AS VARCHAR), 9, '0')) AS listing_id,
      l_partkey AS id, l_linenumber AS i, l_linenumber = 7 OR l_quantity > 45 AS candidate, p_size > 5 AS verified,
      CASE l_partkey % 3 WHEN 0 THEN 'PMA-' || l_partkey WHEN 1 THEN 'SACD ' || l_partkey ELSE 'AX-' || l_partkey END AS name FROM lineitem JOIN part ON p_partkey = l_partkey
  )"""


QUERIES = {f.__name__: f for f in (catalog_matches, manual_categories)}
ORACLES = {
    # the twin of a product without eligibility of its own may still have the name alone, and so may the one that has it as an alias
    "catalog_matches": f"""WITH {_LINES}, pr AS (
    SELECT p_partkey AS id, p_size > 5 AND p_partkey % 7 > 0 AS live, p_size > 5 AND p_partkey % 40 = 0 AND (p_partkey + 10000000) % 7 > 0 AS twin, p_partkey % 3 AS kind, p_brand FROM part
  ), o AS (
    SELECT a.id, a.live AS own, a.twin, coalesce(b.live AND a.id % 40 = 11 AND (a.kind < 2 OR a.p_brand = b.p_brand), false) AS other FROM pr AS a LEFT JOIN pr AS b ON b.id = a.id + 3
  ), c AS (
    SELECT l.*, CASE WHEN i = 5 THEN CASE WHEN own THEN id END WHEN CAST(own AS INTEGER) + CAST(twin AS INTEGER) + CAST(other AS INTEGER) <> 1 THEN NULL WHEN own THEN id WHEN twin THEN id + 10000000 ELSE id + 3 END AS product_id, other AND NOT own AS by_alias
    FROM l JOIN o USING (id) WHERE NOT candidate AND NOT (i = 4 AND id % 3 = 2) AND NOT (i = 6 AND id % 3 = 1)
  ) SELECT listing_id, product_id, CASE WHEN i = 5 THEN 'alias' WHEN i > 1 THEN 'derived_alias' WHEN by_alias THEN 'alias' ELSE 'exact' END AS match_type, CASE WHEN i = 5 THEN 'Q-' || id ELSE name END AS matched_name,
    CASE WHEN product_id % 2 = 0 THEN 'rack,dac' ELSE 'dac,rack' END AS category_ids FROM c WHERE product_id IS NOT NULL""",
    "manual_categories": f"""WITH {_LINES}, pr AS (
    SELECT p_partkey AS id, p_size > 5 AND p_partkey % 7 > 0 AND p_partkey % 4 < 3 AND p_partkey % 5 > 0 AS live,
      p_size > 5 AND p_partkey % 40 = 0 AND (p_partkey + 10000000) % 7 > 0 AND (p_partkey + 10000000) % 4 < 3 AND (p_partkey + 10000000) % 5 > 0 AS twin, p_partkey % 3 AS kind, p_brand FROM part
  ), o AS (
    SELECT a.id, a.live AS own, a.twin, coalesce(b.live AND a.id % 40 = 11 AND (a.kind < 2 OR a.p_brand = b.p_brand), false) AS other FROM pr AS a LEFT JOIN pr AS b ON b.id = a.id + 3
  ), c AS (
    SELECT l.*, CASE WHEN i = 5 THEN CASE WHEN own THEN id END WHEN CAST(own AS INTEGER) + CAST(twin AS INTEGER) + CAST(other AS INTEGER) <> 1 THEN NULL WHEN own THEN id WHEN twin THEN id + 10000000 ELSE id + 3 END AS product_id, other AND NOT own AS by_alias
    FROM l JOIN o USING (id) WHERE candidate AND i IN (1, 5, 7)
  ) SELECT listing_id, product_id, CASE WHEN i = 5 OR by_alias THEN 'alias' ELSE 'exact' END AS match_type, CASE WHEN product_id % 2 = 0 THEN 'rack' ELSE 'dac' END AS category_id FROM c WHERE product_id IS NOT NULL""",
}
