"""The operators on the driver's tables: an offer is a row of lineitem, its entity the part, its shop the supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import entities, ingest, quality, queue, resolution, search
from tidemark.sources import csv_sink
from tidemark.sources import html as html_source


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def offers(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    price = F.floor("l_extendedprice").cast("long")
    return _t(spark, d, "lineitem").select(
        key.alias("listing_id"), F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").cast("string").alias("shop_key"), price.alias("price_yen"),
        F.when(F.col("l_discount") > 0.05, price + 1).alias("previous_price_yen"),
        F.when(F.col("l_returnflag") == "N", "in_stock").when(F.col("l_returnflag") == "R", "sold_out").otherwise("unknown").alias("stock_status"),
        F.col("l_shipdate").cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("source_published_at"),
        F.col("l_shipdate").cast("timestamp").alias("last_activity_at"),
    )


def entity_search(spark, d):
    """Entities with an in-stock offer under a price, cheapest first, each with its representative offer."""
    o = offers(spark, d)
    e = search.same_offer(entities.aggregate(o), o, search.OfferFilter(in_stock=True, max_price=20000))
    top = search.page(e, "priceAsc", 50)
    best = search.representative(o.join(F.broadcast(top.select("entity_id")), "entity_id", "left_semi"))
    return top.join(best.select("entity_id", "listing_id", F.col("price_yen").alias("best_price_yen")), "entity_id").select(
        "entity_id", "offer_count", "in_stock_offer_count", "shop_count", "lowest_price_yen", "highest_price_yen", "listing_id", "best_price_yen"
    )


def entity_aggregates(spark, d):
    return entities.aggregate(offers(spark, d)).drop("latest_activity_at", "newest_listed_at")


def same_offer_filter(spark, d):
    o = offers(spark, d)
    return search.same_offer(entities.aggregate(o).select("entity_id", "offer_count"), o, search.OfferFilter(in_stock=True, price_dropped=True, min_price=10000))


def representative_offers(spark, d):
    return search.representative(offers(spark, d)).select("entity_id", "listing_id", "price_yen", "stock_status")


def cursor_page(spark, d):
    e = entities.aggregate(offers(spark, d))
    at = search.encode_cursor("priceDesc", 50000, 100)
    return search.page(e, "priceDesc", 100, cursor=at).select("entity_id", "lowest_price_yen")


def request_scoped_sort(spark, d):
    """Lowest price over the matching offers only; all matches, in order."""
    o = offers(spark, d).where(search.OfferFilter(in_stock=True, min_price=5000).condition())
    return o.groupBy("entity_id").agg(F.min("price_yen").alias("lowest_matching")).orderBy(F.asc_nulls_last("lowest_matching"), "entity_id")


def brand_facet(spark, d):
    p = _t(spark, d, "part")
    return search.facet(p.select(F.col("p_partkey").alias("entity_id"), F.lower("p_brand").alias("brand_id"), "p_brand"), "brand_id", "p_brand")


def category_closure(spark, d):
    """Shops under each node of a three-level tree: shop, nation, region."""
    s, n, r = (_t(spark, d, x) for x in ("supplier", "nation", "region"))
    up = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = up.select("s_suppkey", F.explode(F.array(F.concat(F.lit("n:"), "n_name"), F.concat(F.lit("r:"), "r_name"))).alias("node"))
    return nodes.groupBy("node").agg(F.count("*").alias("shops"))


def text_search(spark, d):
    doc = _t(spark, d, "documents")
    return doc.where(search.matches(["text", "source"], search.plan_terms("License src1"))).select("doc_id")


def bm25_search(spark, d):
    doc = _t(spark, d, "documents")
    s = search.bm25(doc, "doc_id", {"text": 4.0, "source": 1.0}, search.plan_terms("license apache"))
    return s.select("doc_id", F.round("score", 6).alias("score"))


def trigram_index(spark, d):
    p = _t(spark, d, "part")
    return search.trigrams(p, "p_partkey", "p_name").groupBy("gram").agg(F.count("*").alias("parts"))


def _listings(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    o = offers(spark, d).join(p, F.col("entity_id") == F.col("p_partkey"))
    return o.select(
        "listing_id", "shop_key", F.col("p_brand").alias("manufacturer"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("model"), F.col("p_type").alias("category"),
        F.when(F.col("stock_status") == "unknown", "candidate").otherwise("resolved").alias("model_status"), (F.col("price_yen") < 50000).alias("is_active"),
        "stock_status", "entity_id", "price_yen",
    )


def exact_groups(spark, d):
    return entities.exact_groups(_listings(spark, d).where("is_active"))


def entity_build(spark, d):
    lst = _listings(spark, d)
    cat = _t(spark, d, "part").select(F.col("p_partkey").alias("catalog_product_id"), F.when(F.col("p_size") > 25, "verified").otherwise("pending").alias("verification_status"))
    ids = lst.where("entity_id % 3 = 0").select("listing_id", F.lit("matched").alias("status"), F.col("entity_id").alias("catalog_product_id")).distinct()
    out = entities.build(lst, ids, cat)
    return out.groupBy("entity_key").agg(F.count("*").alias("listings"))


def first_terms(spark, d):
    o = offers(spark, d)
    return entities.first_terms(o.select("entity_id", "listing_id"), "listing_id")


def split_groups(spark, d):
    p = _t(spark, d, "part")
    return entities.split_groups(p.select(F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.col("p_partkey").alias("entity_id")))


def unambiguous_names(spark, d):
    p = _t(spark, d, "part")
    return resolution.unambiguous(p.select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name"], "p_partkey")


def similar_customers(spark, d):
    c = _t(spark, d, "customer")
    a, b = (c.select("c_nationkey", F.col("c_name").alias(x)) for x in "ab")
    return resolution.similar(a, b, "c_nationkey", "a", "b").groupBy("b").agg(F.count("*").alias("n"))


def _observations(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("shop_key"), F.col("event_type").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"), F.floor("value").cast("long").alias("price_yen"))
    return e.withColumns({"title": F.col("source_id"), "stock_status": F.lit("in_stock")})


def crawl_fold(spark, d):
    """State as of mid month (last observation before), folded with all later observations."""
    o = _observations(spark, d)
    last = Window.partitionBy(*ingest.KEY).orderBy(F.desc("ts"), F.desc("event_id"))
    old = o.where("ts < '2024-01-15'").withColumn("n", F.row_number().over(last)).where("n = 1")
    state = old.select(*ingest.KEY, "title", "price_yen", "stock_status", F.lit(None).cast("long").alias("previous_price_yen"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), F.lit(True).alias("is_active"))
    new = o.where("ts >= '2024-01-15'").withColumn("n", F.row_number().over(last)).where("n = 1")
    out = ingest.fold(state, new.select(*ingest.KEY, "title", "price_yen", "stock_status"), "2024-02-01 00:00:00", True)
    return out.groupBy("action").agg(F.count("*").alias("n"), F.sum("price_yen").alias("price_sum"), F.count("previous_price_yen").alias("with_previous"), F.count_if("is_active").alias("active"))


def price_drops(spark, d):
    o = offers(spark, d)
    w = Window.partitionBy("entity_id").orderBy("last_activity_at", "listing_id")
    return o.withColumn("before", F.lag("price_yen").over(w)).where("price_yen < before").groupBy("entity_id").agg(F.count("*").alias("drops"), F.max(F.col("before") - F.col("price_yen")).alias("largest"))


def evidence_burst(spark, d):
    e = _t(spark, d, "events")
    t = F.col("ts").cast("timestamp").cast("long")
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-86400, 0)
    return e.withColumn("t", t).withColumn("n", F.count("*").over(w)).groupBy("user_id").agg(F.max("n").alias("most_in_a_day"))


def evidence_sample(spark, d):
    e = _t(spark, d, "events")
    h = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type")), 256)
    return e.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 10 == 0).select("event_id", h.alias("content_hash"))


def quality_snapshot(spark, d):
    lst = _listings(spark, d)
    ids = lst.where("entity_id % 3 = 0").select("listing_id", F.lit("matched").alias("status")).distinct()
    s = quality.snapshot(lst, ids)
    r = quality.rate(F.col("inventory_unknown"), F.col("total_items"))
    return s.withColumns({"unknown_level": quality.level(r, 0.3, 0.36), "matched_level": quality.level(quality.rate(F.col("identity_matched"), F.col("total_items")), 0.32, 0.28, False)}).withColumn("overall", quality.worst(F.col("unknown_level"), F.col("matched_level")))


def latest_runs(spark, d):
    o = _t(spark, d, "orders").withColumn("linked", F.col("o_orderstatus") == "F")
    return quality.latest(o, "o_custkey", "o_orderdate", "o_orderkey", "linked")


def daily_trend(spark, d):
    e = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.trend(e, "event_type", "day", "n").withColumn("history", F.array_join(F.transform("history", lambda x: x.cast("string")), ","))


def shop_health(spark, d):
    e = _t(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("shop_key")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts").cast("timestamp"))).alias("last_success_at"), F.lit(0).alias("consecutive_failures"))
    return quality.health(s, "2024-01-31 00:00:00", 1440).groupBy("state").agg(F.count("*").alias("shops"))


def _queue(spark, d):
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), at.alias("available_at"),
        at.alias("lease_expires_at"), (F.col("o_orderkey") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"),
    )


def queue_claim(spark, d):
    return queue.claim(_queue(spark, d), "1997-01-01 00:00:00", 100).select("id", "priority", "status")


def queue_settle(spark, d):
    c = _queue(spark, d).where("status = 'pending' AND attempt_count < max_attempts")
    s = queue.settle(c, F.col("id") % 2 == 0, "1997-01-01 00:00:00")
    return s.groupBy("status", "attempt_count").agg(F.count("*").alias("n"))


def queue_metrics(spark, d):
    return queue.metrics(_queue(spark, d))


def retention(spark, d):
    return queue.retain(_t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "2024-01-10 00:00:00", 500, "event_id").select("event_id")


def export_lines(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return csv_sink.lines(c, ["c_custkey"])


def export_page(spark, d):
    c = _t(spark, d, "customer")
    return c.where("c_custkey > 100 AND c_custkey <= 1000").orderBy("c_custkey").limit(251).select("c_custkey", "c_name")


def json_metadata(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def page_links(spark, d):
    return html_source.links(_t(spark, d, "pages")).groupBy("url").agg(F.count("*").alias("links"))


def latest_turn(spark, d):
    c = _t(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


def admin_search(spark, d):
    c = _t(spark, d, "customer")
    return c.where(search.matches(["c_name", "c_mktsegment"], ["auto", "9"])).orderBy("c_custkey").limit(100).select("c_custkey", "c_name")


def gap_listings(spark, d):
    """Listings without any in-stock sibling, or whose entity is no verified product: two anti joins, either suffices."""
    o = offers(spark, d)
    live = o.where("stock_status = 'in_stock'").select("entity_id").distinct()
    known = _t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("entity_id"))
    return o.join(live.withColumn("a", F.lit(1)), "entity_id", "left").join(known.withColumn("b", F.lit(1)), "entity_id", "left").where("a IS NULL OR b IS NULL").select("listing_id")


ALL = [
    entity_search, entity_aggregates, same_offer_filter, representative_offers, cursor_page, request_scoped_sort, brand_facet, category_closure,
    text_search, bm25_search, trigram_index, exact_groups, entity_build, first_terms, split_groups, unambiguous_names, similar_customers,
    crawl_fold, price_drops, evidence_burst, evidence_sample, quality_snapshot, latest_runs, daily_trend, shop_health, queue_claim, queue_settle, queue_metrics,
    retention, export_lines, export_page, json_metadata, page_links, latest_turn, admin_search, gap_listings,
]
