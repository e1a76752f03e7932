"""The registered queries in DuckDB SQL."""

from __future__ import annotations

_OFFERS = """offers AS (
  SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(l_linenumber AS VARCHAR), 9, '0')) AS listing_id,
    l_partkey AS entity_id, CAST(l_suppkey AS VARCHAR) AS shop_key, CAST(floor(l_extendedprice) AS BIGINT) AS price_yen,
    CASE WHEN l_discount > 0.05 THEN CAST(floor(l_extendedprice) AS BIGINT) + 1 END AS previous_price_yen,
    CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'R' THEN 'sold_out' ELSE 'unknown' END AS stock_status, l_shipdate AS seen_at
  FROM lineitem
)"""
_ENTITIES = """entities AS (
  SELECT entity_id, count(*) AS offer_count, count(*) FILTER (WHERE stock_status = 'in_stock') AS in_stock_offer_count,
    count(*) FILTER (WHERE stock_status = 'sold_out') AS sold_out_offer_count, count(DISTINCT shop_key) AS shop_count,
    min(price_yen) AS lowest_price_yen, min(price_yen) FILTER (WHERE stock_status = 'in_stock') AS lowest_in_stock_price_yen,
    max(price_yen) AS highest_price_yen, CAST(coalesce(bool_or(price_yen < previous_price_yen), false) AS INTEGER) AS has_price_drop
  FROM offers GROUP BY entity_id
)"""
_BEST = """best AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN stock_status = 'in_stock' THEN 0 ELSE 1 END, price_yen NULLS LAST, seen_at DESC, listing_id) AS n FROM offers
)"""
_LISTINGS = """listings AS (
  SELECT listing_id, shop_key, p_brand AS manufacturer, p_name || ' ' || p_partkey AS model, p_type AS category,
    CASE WHEN stock_status = 'unknown' THEN 'candidate' ELSE 'resolved' END AS model_status, price_yen < 50000 AS is_active, stock_status, entity_id
  FROM offers JOIN part ON entity_id = p_partkey
)"""
_GROUPS = """groups AS (
  SELECT manufacturer, model, min(listing_id) AS leader FROM {0} WHERE model_status = 'resolved' AND manufacturer <> '' AND model <> ''
  GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN category NOT IN ('other', 'unclassified') THEN category END) <= 1
)"""
_QUEUE = """queue AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS due_at, CAST(o_orderkey % 4 AS INTEGER) AS attempt_count FROM orders
)"""

ORACLES = {
    "entity_search": f"""WITH {_OFFERS}, {_ENTITIES}, {_BEST}, top AS (
      SELECT * FROM entities WHERE entity_id IN (SELECT entity_id FROM offers WHERE stock_status = 'in_stock' AND price_yen <= 20000)
      ORDER BY lowest_price_yen NULLS LAST, entity_id LIMIT 51
    ) SELECT top.entity_id, offer_count, in_stock_offer_count, shop_count, lowest_price_yen, highest_price_yen, listing_id, price_yen AS best_price_yen
    FROM top JOIN best ON best.entity_id = top.entity_id AND n = 1""",
    "entity_aggregates": f"WITH {_OFFERS}, {_ENTITIES} SELECT * FROM entities",
    "same_offer_filter": f"""WITH {_OFFERS}, {_ENTITIES} SELECT entity_id, offer_count FROM entities WHERE entity_id IN (
      SELECT entity_id FROM offers WHERE stock_status = 'in_stock' AND price_yen < previous_price_yen AND price_yen >= 10000)""",
    "representative_offers": f"WITH {_OFFERS}, {_BEST} SELECT entity_id, listing_id, price_yen, stock_status FROM best WHERE n = 1",
    "cursor_page": f"""WITH {_OFFERS}, {_ENTITIES} SELECT entity_id, lowest_price_yen FROM entities
      WHERE lowest_price_yen < 50000 OR lowest_price_yen = 50000 AND entity_id < 100 OR lowest_price_yen IS NULL ORDER BY lowest_price_yen DESC NULLS LAST, entity_id DESC LIMIT 101""",
    "request_scoped_sort": f"""WITH {_OFFERS} SELECT entity_id, min(price_yen) AS lowest_matching FROM offers WHERE stock_status = 'in_stock' AND price_yen >= 5000
      GROUP BY entity_id ORDER BY lowest_matching NULLS LAST, entity_id""",
    "brand_facet": "SELECT lower(p_brand) AS brand_id, min(p_brand) AS name, count(DISTINCT p_partkey) AS entities FROM part GROUP BY 1",
    "category_closure": """WITH u AS (SELECT n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT 'n:' || n_name AS node, count(*) AS shops FROM u GROUP BY 1 UNION ALL SELECT 'r:' || r_name, count(*) FROM u GROUP BY 1""",
    "text_search": "SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))",
    "bm25_search": r"""WITH d AS (
      SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents
    ), r AS (
      SELECT doc_id, len(regexp_split_to_array(t, '\s+')) + len(regexp_split_to_array(s, '\s+')) AS n,
        4.0 * (length(t) - length(replace(t, 'license', ''))) / 7 + 1.0 * (length(s) - length(replace(s, 'license', ''))) / 7 AS a,
        4.0 * (length(t) - length(replace(t, 'apache', ''))) / 6 + 1.0 * (length(s) - length(replace(s, 'apache', ''))) / 6 AS b FROM d
    ), g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM r)
    SELECT doc_id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * CAST(a AS DOUBLE) * 2.2 / (CAST(a AS DOUBLE) + 1.2 * (0.25 + 0.75 * n / mean))
      + ln((docs - db + 0.5) / (db + 0.5) + 1) * CAST(b AS DOUBLE) * 2.2 / (CAST(b AS DOUBLE) + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
    FROM r, g WHERE a > 0 OR b > 0""",
    "trigram_index": """SELECT gram, count(*) AS parts FROM (
      SELECT DISTINCT p_partkey, substr(lower(p_name), i, 3) AS gram FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY gram""",
    "exact_groups": f"WITH {_OFFERS}, {_LISTINGS}, active AS (SELECT * FROM listings WHERE is_active), {_GROUPS.format('active')} SELECT manufacturer, model, leader AS entity_id FROM groups",
    "entity_build": f"""WITH {_OFFERS}, {_LISTINGS}, rows AS (
      SELECT l.*, CASE WHEN entity_id % 3 = 0 AND p_size > 25 THEN entity_id END AS product FROM listings AS l JOIN part ON p_partkey = entity_id WHERE is_active
    ), rest AS (SELECT * FROM rows WHERE product IS NULL), {_GROUPS.format('rest')}
    SELECT CASE WHEN product IS NOT NULL THEN 'c-' || product ELSE 'l-' || coalesce(CASE WHEN model_status = 'resolved' THEN leader END, listing_id) END AS entity_key, count(*) AS listings
    FROM rows LEFT JOIN groups USING (manufacturer, model) GROUP BY 1""",
    "first_terms": f"""WITH {_OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY listing_id) AS n FROM offers)
      SELECT entity_id, string_agg(listing_id, ' ' ORDER BY n) AS terms FROM r WHERE n <= 3 GROUP BY entity_id""",
    "split_groups": "SELECT p_brand AS manufacturer, p_name AS model, count(*) AS listings, count(DISTINCT p_partkey) AS entities FROM part GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT p_partkey) > 1",
    "unambiguous_names": "SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1",
    "similar_customers": """SELECT y.c_name AS b, count(DISTINCT x.c_name) AS n FROM customer AS x JOIN customer AS y ON x.c_nationkey = y.c_nationkey
      WHERE x.c_name <> y.c_name AND levenshtein(x.c_name, y.c_name) <= 1 GROUP BY 1""",
    "crawl_fold": """WITH o AS (
      SELECT CAST(user_id AS VARCHAR) AS shop, event_type AS src, ts, event_id, CAST(floor(value) AS BIGINT) AS price FROM events
    ), s AS (SELECT *, row_number() OVER (PARTITION BY shop, src ORDER BY ts DESC, event_id DESC) AS n FROM o WHERE ts < '2024-01-15'
    ), b AS (SELECT *, row_number() OVER (PARTITION BY shop, src ORDER BY ts DESC, event_id DESC) AS n FROM o WHERE ts >= '2024-01-15'
    ), j AS (
      SELECT s.price AS old, b.price AS new, s.shop IS NOT NULL AS known, b.shop IS NOT NULL AS seen, s.ts AS last
      FROM (SELECT * FROM s WHERE n = 1) AS s FULL JOIN (SELECT * FROM b WHERE n = 1) AS b ON s.shop = b.shop AND s.src = b.src
    ), a AS (
      SELECT *, CASE WHEN NOT known THEN 'insert' WHEN seen AND old <> new THEN 'update' WHEN seen AND last <= TIMESTAMP '2024-02-01' - INTERVAL 360 MINUTES THEN 'touch' WHEN NOT seen THEN 'deactivate' ELSE 'none' END AS action FROM j
    ) SELECT action, count(*) AS n, CAST(sum(CASE WHEN action IN ('insert', 'update') THEN new ELSE old END) AS BIGINT) AS price_sum,
      count(*) FILTER (WHERE action = 'update') AS with_previous, count(*) FILTER (WHERE action <> 'deactivate') AS active FROM a GROUP BY action""",
    "price_drops": f"""WITH {_OFFERS}, w AS (SELECT entity_id, price_yen, lag(price_yen) OVER (PARTITION BY entity_id ORDER BY seen_at, listing_id) AS before FROM offers)
      SELECT entity_id, count(*) AS drops, max(before - price_yen) AS largest FROM w WHERE price_yen < before GROUP BY entity_id""",
    "evidence_burst": """SELECT user_id, max(n) AS most_in_a_day FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id""",
    "evidence_sample": """SELECT event_id, sha256(event_id || ':' || event_type) AS content_hash FROM events WHERE CAST('0x' || substr(sha256(event_id || ':' || event_type), 1, 8) AS BIGINT) % 10 = 0""",
    "quality_snapshot": f"""WITH {_OFFERS}, {_LISTINGS}, s AS (
      SELECT shop_key, count(*) AS total_items, count(*) FILTER (WHERE coalesce(manufacturer, '') = '') AS manufacturer_missing, count(*) FILTER (WHERE category = 'unclassified') AS category_unclassified,
        count(*) FILTER (WHERE entity_id % 3 = 0) AS identity_matched, count(*) FILTER (WHERE entity_id % 3 <> 0) AS identity_unresolved, count(*) FILTER (WHERE stock_status = 'unknown') AS inventory_unknown
      FROM listings WHERE is_active GROUP BY shop_key
    ), l AS (
      SELECT *, CASE WHEN inventory_unknown::DOUBLE / total_items >= 0.36 THEN 'critical' WHEN inventory_unknown::DOUBLE / total_items >= 0.3 THEN 'warning' ELSE 'healthy' END AS unknown_level,
        CASE WHEN identity_matched::DOUBLE / total_items <= 0.28 THEN 'critical' WHEN identity_matched::DOUBLE / total_items <= 0.32 THEN 'warning' ELSE 'healthy' END AS matched_level FROM s
    ) SELECT *, CASE WHEN 'critical' IN (unknown_level, matched_level) THEN 'critical' WHEN 'warning' IN (unknown_level, matched_level) THEN 'warning' ELSE 'healthy' END AS overall FROM l""",
    "latest_runs": """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS latest_linked_id FROM orders GROUP BY o_custkey""",
    "daily_trend": """WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS v FROM events GROUP BY 1, 2
    ), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM m
    ), t AS (SELECT event_type, max(v) FILTER (WHERE n = 1) AS value, max(v) FILTER (WHERE n = 2) AS previous, string_agg(CAST(v AS VARCHAR), ',' ORDER BY n DESC) FILTER (WHERE n <= 12) AS history FROM r GROUP BY 1)
    SELECT *, value - previous AS delta, CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' WHEN value = previous THEN 'flat' ELSE 'unknown' END AS direction FROM t""",
    "shop_health": """WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS ok FROM events GROUP BY 1)
      SELECT CASE WHEN ok IS NULL THEN 'critical' WHEN (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ok))) / 60 > 4320 THEN 'warning' ELSE 'healthy' END AS state, count(*) AS shops FROM s GROUP BY 1""",
    "queue_claim": f"""WITH {_QUEUE} SELECT id, priority, status FROM queue WHERE attempt_count < 3 AND (status = 'pending' AND due_at <= '1997-01-01' OR status = 'processing' AND due_at < '1997-01-01')
      ORDER BY priority DESC, due_at, id LIMIT 100""",
    "queue_settle": f"""WITH {_QUEUE} SELECT CASE WHEN id % 2 = 0 THEN 'resolved' WHEN attempt_count + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, attempt_count + 1 AS attempt_count, count(*) AS n
      FROM queue WHERE status = 'pending' AND attempt_count < 3 GROUP BY 1, 2""",
    "queue_metrics": f"""WITH {_QUEUE} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'resolved') AS resolved,
      CAST(0 AS BIGINT) AS failed, CAST(0 AS DOUBLE) AS failure_rate FROM queue""",
    "retention": "SELECT event_id FROM events WHERE ts < '2024-01-10' ORDER BY ts, event_id LIMIT 500",
    "export_lines": """SELECT c_custkey, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || replace(c_mktsegment, '"', '""') || '",""' AS line FROM customer""",
    "export_page": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 AND c_custkey <= 1000 ORDER BY c_custkey LIMIT 251",
    "json_metadata": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "page_links": """WITH a AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]+)">', 1)) AS link FROM pages) SELECT url, count(DISTINCT link) AS links FROM a GROUP BY url""",
    "latest_turn": "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id",
    "admin_search": "SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')) AND (contains(lower(c_name), '9') OR contains(lower(c_mktsegment), '9')) ORDER BY c_custkey LIMIT 100",
    "gap_listings": f"""WITH {_OFFERS} SELECT listing_id FROM offers WHERE
      NOT EXISTS (SELECT 1 FROM offers AS o WHERE o.entity_id = offers.entity_id AND o.stock_status = 'in_stock')
      OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = offers.entity_id AND p_size > 10)""",
}
