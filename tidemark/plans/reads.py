"""Reads on the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import entities, ingest, reads, resolution, search
from tidemark.operators.text_index import TextIndex
from tidemark.sources.shared import new_folder

from .listings import _t, offers
from .oracles import _ENTITIES, _OFFERS


def keyset_scan(spark, d):
    return reads.keyset_page(_t(spark, d, "customer"), "c_custkey", after=100, limit=500).select("c_custkey", "c_name")


def export_horizon(spark, d):
    return reads.keyset_page(_t(spark, d, "orders"), "o_orderkey", after=50, upto=5000).select("o_orderkey", "o_orderstatus")


def search_totals(spark, d):
    return reads.totals(entities.aggregate(offers(spark, d)).where("in_stock_offer_count > 0"), 50)


def capped_total(spark, d):
    return reads.capped_count(offers(spark, d).where("price_yen < 30000"), 1000)


def entity_samples(spark, d):
    return reads.json_samples(offers(spark, d), "entity_id", reads.representative_order(), ["listing_id", "price_yen"], 3)


def offer_details(spark, d):
    return reads.detail(offers(spark, d), 7).select("listing_id", "shop_key", "price_yen", "stock_status")


def previous_orders(spark, d):
    """Each customer's latest order but one."""
    o = _t(spark, d, "orders")
    return reads.nth_latest(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


def customer_history(spark, d):
    return reads.history(_t(spark, d, "orders"), "o_orderpriority", "1-URGENT", "o_orderdate", "o_orderkey", 500).select("o_orderkey")


def category_tree(spark, d):
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("sort"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("sort"))
    out = reads.with_ancestors_order(r.unionByName(n), "id", "parent", "sort")
    return out.select("id", "level", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


def either_key(spark, d):
    c, s = _t(spark, d, "customer").select("c_custkey", "c_nationkey"), _t(spark, d, "supplier")
    return reads.by_either_key(c, s, [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")], "s_name")


def prefix_titles(spark, d):
    return _t(spark, d, "part").where(reads.starts_with_any("p_type", ["promo", "STANDARD b", "100%"])).select("p_partkey", "p_type")


def due_shops(spark, d):
    s = _t(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("enabled"),
        F.when(F.col("s_suppkey") % 5 > 0, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 90).cast("int")).cast("timestamp")).alias("last_attempt_at"),
    )
    return reads.due(s, "1997-02-15 00:00:00", 1440, 50).select("source_id")


def replay_due(spark, d):
    o = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("product_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_orderstatus").alias("kind")
    )
    p = o.groupBy("product_id").agg(F.max(F.when(F.col("kind") == "O", F.col("at"))).alias("last_verified_at"), F.max(F.when(F.col("kind") == "F", F.col("at"))).alias("last_remediated_at"))
    return reads.to_replay(p).select("product_id")


def row_checks(spark, d):
    c = _t(spark, d, "customer")
    rows = c.select(
        F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).alias("listing_id"), F.when(F.col("c_custkey") % 13 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("title"),
        F.floor("c_acctbal").cast("long").alias("price_yen"), F.concat(F.when(F.col("c_custkey") % 7 == 0, "ftp://").otherwise("HTTPS://"), F.lit("h.x/"), "c_custkey").alias("url"),
    )
    return reads.check_rows(rows).groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("n"))


def shop_thresholds(spark, d):
    o = offers(spark, d)
    m = o.groupBy("shop_key").agg((F.count_if(F.col("stock_status") == "unknown") * 10000 / F.count("*")).cast("long").alias("value")).withColumn("metric", F.lit("inventory_unknown"))
    common = spark.sql("SELECT * FROM VALUES ('inventory_unknown', 2400L, 2600L) AS t(metric, warning, critical)")
    own = _t(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("string").alias("shop_key"), F.lit("inventory_unknown").alias("metric"), F.lit(100).cast("long").alias("warning"), F.lit(None).cast("long").alias("critical"))
    return reads.with_thresholds(m, common, own)


def identity_resolution(spark, d):
    """Listings of all kinds of evidence: exact in another spelling, alias, one edit, other variant, nothing, no model, and names that two products claim."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("AX"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("name"))
    catalog = p.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("manufacturer_id"), F.col("name").alias("canonical_model"), F.array(F.concat(F.lit("Q"), F.reverse("name"))).alias("aliases"))
    other = p.where("p_partkey % 50 < 2").select((F.col("p_partkey") + 10_000_000).alias("product_id"), F.col("p_brand").alias("manufacturer_id"), F.when(F.col("p_partkey") % 50 == 0, F.col("name")).otherwise(F.concat(F.lit("OTHER"), "name")).alias("canonical_model"), F.array(F.concat(F.lit("Q"), F.reverse("name"))).alias("aliases"))
    catalog = catalog.unionByName(other)
    line = _t(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    model = (
        F.when(n == 1, F.concat(F.lit("ax-"), F.substring("name", 3, 9))).when(n == 2, F.concat(F.lit("q "), F.reverse("name"))).when(n == 3, F.concat("name", F.lit("T")))
        .when(n == 4, F.concat("name", F.lit(" MK II"))).when(n == 5, F.lit("ZZTOP 9000 ZZ")).when(n == 6, F.col("name")).when((n == 7) & (F.col("p_partkey") % 2 == 0), F.concat(F.substring("name", 1, 8), F.lit("T")))
    )
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = line.select(key.alias("listing_id"), F.col("p_brand").alias("manufacturer_id"), model.alias("model"), F.when(n == 6, "unresolved").otherwise("resolved").alias("model_status"))
    return resolution.resolve(rows, catalog).groupBy("status", "method").agg(F.count("*").alias("n"), F.sum("catalog_product_id").alias("products"), F.sum("candidate_id").alias("candidates"))


def indexed_search(spark, d):
    """Parts whose type holds all terms, by a stored index: what is read is the postings of the terms' own trigrams."""
    p = _t(spark, d, "part").select("p_partkey", "p_type")
    found = TextIndex(spark, new_folder(spark, "index"), "p_partkey", ("p_type",)).create(p).search("Econ  OMY")
    return p.join(found, "p_partkey", "left_semi")


def relevance_order(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("manufacturer_id"), F.lower("p_type").alias("model"), F.col("p_size").alias("score"))
    rank = search.relevance("Brand#8", "promo")
    return p.withColumn("tier", rank).orderBy("tier", F.desc("score"), F.desc("entity_id")).limit(100).select("entity_id", "tier")


def evidence_quotas(spark, d):
    """Objects of shops within quotas of the day, of the shop's day and of a quarter of an hour; a repeated object only once."""
    e = _t(spark, d, "events").where("ts IS NOT NULL").select(
        "event_id", F.col("user_id").cast("string").alias("shop_key"), F.col("ts").cast("timestamp").alias("at"), F.concat_ws("-", F.col("event_id") % 800, F.col("user_id") % 7).alias("content_hash")
    )
    return ingest.quotas(e, 40, 3, 2).where("accepted").select("event_id")


QUERIES = {
    f.__name__: f
    for f in (
        keyset_scan, export_horizon, search_totals, capped_total, entity_samples, offer_details, previous_orders, customer_history, category_tree, either_key,
        prefix_titles, due_shops, replay_due, row_checks, shop_thresholds, identity_resolution, indexed_search, relevance_order, evidence_quotas,
    )
}

_REPRESENTATIVE = "CASE WHEN stock_status = 'in_stock' THEN 0 ELSE 1 END, price_yen NULLS LAST, seen_at DESC, listing_id"
_NAMED = "p AS (SELECT p_partkey, p_brand, 'AX' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS name FROM part)"

ORACLES = {
    "keyset_scan": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 500",
    "export_horizon": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 5000",
    "search_totals": f"WITH {_OFFERS}, {_ENTITIES} SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM entities WHERE in_stock_offer_count > 0",
    "capped_total": f"WITH {_OFFERS} SELECT least(count(*), 1000) AS n, count(*) > 1000 AS more FROM offers WHERE price_yen < 30000",
    "entity_samples": f"""WITH {_OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {_REPRESENTATIVE}) AS n FROM offers)
SELECT entity_id, '[' || string_agg('{{"listing_id":"' || listing_id || '","price_yen":' || price_yen || '}}', ',' ORDER BY n) || ']' AS samples FROM r WHERE n <= 3 GROUP BY entity_id""",
    "offer_details": f"WITH {_OFFERS} SELECT listing_id, shop_key, price_yen, stock_status FROM offers WHERE entity_id = 7 ORDER BY {_REPRESENTATIVE} LIMIT 200",
    "previous_orders": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2",
    "customer_history": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "category_tree": """SELECT 'r' || r_regionkey AS id, CAST(1 AS INTEGER) AS level, CAST(r_regionkey AS VARCHAR) AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 2, n_regionkey || '.' || n_nationkey FROM nation""",
    "either_key": """SELECT c_custkey, c_nationkey, coalesce(a.s, b.s) AS s_name, CASE WHEN a.s IS NOT NULL THEN 'c_custkey' WHEN b.s IS NOT NULL THEN 'c_nationkey' END AS met_by
FROM customer LEFT JOIN (SELECT s_suppkey, min(s_name) AS s FROM supplier GROUP BY 1) AS a ON c_custkey = a.s_suppkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS s FROM supplier GROUP BY 1) AS b ON c_nationkey = b.s_nationkey""",
    "prefix_titles": "SELECT p_partkey, p_type FROM part WHERE starts_with(lower(p_type), 'promo') OR starts_with(lower(p_type), 'standard b') OR starts_with(lower(p_type), '100%')",
    "due_shops": """WITH s AS (SELECT s_suppkey AS source_id, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 5 > 0 THEN TIMESTAMP '1997-01-01' + to_days(CAST(s_suppkey % 90 AS INTEGER)) END AS tried FROM supplier)
SELECT source_id FROM s WHERE enabled AND (tried IS NULL OR tried <= TIMESTAMP '1997-02-14') ORDER BY tried NULLS FIRST, source_id LIMIT 50""",
    "replay_due": """WITH p AS (SELECT o_custkey AS product_id, max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS v, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS r FROM orders GROUP BY 1)
SELECT product_id FROM p WHERE v IS NOT NULL AND (r IS NULL OR r < v)""",
    "row_checks": """WITH r AS (SELECT array_to_string(list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'no_id' END, CASE WHEN c_custkey % 13 = 0 OR trim(c_name) = '' THEN 'no_title' END,
  CASE WHEN floor(c_acctbal) <= 0 THEN 'bad_price' END, CASE WHEN c_custkey % 7 = 0 THEN 'bad_url' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer)
SELECT problems, count(*) AS n FROM r GROUP BY 1""",
    "shop_thresholds": f"""WITH {_OFFERS}, m AS (SELECT shop_key, CAST(floor(count(*) FILTER (WHERE stock_status = 'unknown') * 10000 / count(*)) AS BIGINT) AS value FROM offers GROUP BY 1),
t AS (SELECT shop_key, 'inventory_unknown' AS metric, value, CAST(CASE WHEN CAST(shop_key AS BIGINT) % 10 = 0 THEN 100 ELSE 2400 END AS BIGINT) AS warning, CAST(2600 AS BIGINT) AS critical FROM m)
SELECT *, CASE WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' ELSE 'healthy' END AS level FROM t""",
    "identity_resolution": f"""WITH {_NAMED}, l AS (
  SELECT l_orderkey || '-' || l_linenumber AS listing_id, p_brand, l_linenumber = 6 AS open,
    CASE l_linenumber WHEN 1 THEN 'ax-' || substr(name, 3, 9) WHEN 2 THEN 'q ' || reverse(name) WHEN 3 THEN name || 'T' WHEN 4 THEN name || ' MK2' WHEN 5 THEN 'ZZTOP 9000 ZZ' WHEN 6 THEN name WHEN 7 THEN CASE WHEN l_partkey % 2 = 0 THEN substr(name, 1, 8) || 'T' END END AS model
  FROM lineitem JOIN p ON l_partkey = p_partkey
), m AS (SELECT *, regexp_replace(upper(coalesce(model, '')), '[^A-Z0-9]', '', 'g') AS key FROM l),
k AS (SELECT DISTINCT p_brand, key FROM m),
c AS (SELECT p_partkey AS id, p_brand, name, 'Q' || reverse(name) AS alias FROM p
  UNION ALL SELECT p_partkey + 10000000, p_brand, CASE WHEN p_partkey % 50 = 0 THEN name ELSE 'OTHER' || name END, 'Q' || reverse(name) FROM p WHERE p_partkey % 50 < 2),
x AS (SELECT k.p_brand, k.key, min(id) AS exact, count(*) AS exact_n FROM k JOIN c ON c.p_brand = k.p_brand AND c.name = k.key GROUP BY 1, 2),
a AS (SELECT k.p_brand, k.key, min(id) AS alias, count(*) AS alias_n FROM k JOIN c ON c.p_brand = k.p_brand AND c.alias = k.key GROUP BY 1, 2),
v AS (SELECT k.p_brand, k.key, min(id) AS veto FROM k JOIN c ON c.p_brand = k.p_brand AND c.name || 'MK2' = k.key GROUP BY 1, 2),
f AS (SELECT k.p_brand, k.key, min(id) AS fuzzy, count(*) AS n FROM k JOIN c ON c.p_brand = k.p_brand AND abs(length(c.name) - length(k.key)) <= 1 AND c.name <> k.key AND levenshtein(c.name, k.key) <= 1 GROUP BY 1, 2),
r AS (SELECT CASE WHEN key = '' THEN 'missing_fields' WHEN open THEN 'unresolved_model' WHEN exact_n = 1 THEN 'manufacturer_model_exact' WHEN exact_n > 1 THEN 'exact_ambiguous'
    WHEN alias_n = 1 THEN 'manufacturer_alias' WHEN alias_n > 1 THEN 'alias_ambiguous'
    WHEN veto IS NOT NULL THEN 'vetoed' WHEN n = 1 THEN 'fuzzy_candidate' WHEN n > 1 THEN 'fuzzy_ambiguous' ELSE 'none' END AS method, exact, alias, veto, fuzzy
  FROM m LEFT JOIN x USING (p_brand, key) LEFT JOIN a USING (p_brand, key) LEFT JOIN v USING (p_brand, key) LEFT JOIN f USING (p_brand, key))
SELECT CASE WHEN method LIKE 'manufacturer%' THEN 'matched' WHEN method IN ('exact_ambiguous', 'alias_ambiguous') THEN 'ambiguous' ELSE 'unresolved' END AS status, method, count(*) AS n,
  CAST(sum(CASE method WHEN 'manufacturer_model_exact' THEN exact WHEN 'manufacturer_alias' THEN alias END) AS BIGINT) AS products,
  CAST(sum(CASE WHEN method = 'vetoed' THEN veto WHEN method = 'exact_ambiguous' THEN exact WHEN method = 'alias_ambiguous' THEN alias WHEN method LIKE 'fuzzy%' THEN fuzzy END) AS BIGINT) AS candidates FROM r GROUP BY 1, 2""",
    "indexed_search": "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'econ') AND contains(lower(p_type), 'omy')",
    "evidence_quotas": """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS shop_key, ts AS t, (event_id % 800) || '-' || (user_id % 7) AS h FROM events WHERE ts IS NOT NULL),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY t, shop_key) = 1 THEN 1 ELSE 0 END AS new, CAST(floor(epoch(t)) AS BIGINT) AS s FROM e),
c AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY CAST(t AS DATE) ORDER BY t, h, shop_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day,
  coalesce(sum(new) OVER (PARTITION BY shop_key, CAST(t AS DATE) ORDER BY t, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shop,
  sum(new) OVER (PARTITION BY shop_key ORDER BY s RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS near FROM f)
SELECT event_id FROM c WHERE new = 1 AND day < 40 AND shop < 3 AND near <= 2""",
    "relevance_order": """SELECT p_partkey AS entity_id, CAST(CASE WHEN p_brand = 'Brand#8' AND lower(p_type) = 'promo' THEN 0 WHEN lower(p_type) = 'promo' THEN 1 ELSE 3 END AS INTEGER) AS tier
FROM part ORDER BY tier, p_size DESC, p_partkey DESC LIMIT 100""",
}
