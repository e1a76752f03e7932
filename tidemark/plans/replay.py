"""Replay on the driver's tables: parts as listings, brands as makers; each query with its DuckDB SQL.

Before, brands whose number divides by 5 were pending; then those that divide by 10 were verified, and their listings are replayed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.sources.shared import new_folder, written

from .listings import _t

VERSIONS = {"manufacturer": 3, "model": 2, "category": 14, "identity": 5}


def _aliases(spark, d, verified_now):
    p = _t(spark, d, "part")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    pending = (number % 5 == 0) & ~((number % 10 == 0) if verified_now else F.lit(False))
    return p.select(F.lower("p_brand").alias("manufacturer_id"), F.col("p_brand").alias("canonical_name"), F.col("p_brand").alias("alias"), F.when(pending, "pending").otherwise("verified").alias("verification_status"), F.lit("review").alias("source"), number.alias("number")).distinct()


def _listings(spark, d):
    p = _t(spark, d, "part")
    turn = F.col("p_partkey") % 3
    none = F.lit("")
    return p.select(
        F.col("p_partkey").alias("listing_id"), (F.col("p_size") < 48).alias("is_active"), F.when(turn == 0, F.upper("p_brand")).when(turn == 1, "").otherwise("不明").alias("raw_manufacturer"), none.alias("manufacturer_candidate"),
        F.concat_ws(" ", "p_brand", "p_name").alias("title"), F.concat(F.lit("AX-"), F.col("p_partkey").cast("string")).alias("raw_model"),
        *(none.alias(c) for c in replay.FIELDS[:8]), F.lit(1).alias("manufacturer_version"), F.lit(1).alias("model_version"), (F.col("p_partkey") % 20).cast("int").alias("category_version"),
        (F.col("p_partkey") % 7).cast("int").alias("identity_version"), (F.col("p_partkey") % 11 == 0).alias("projection_required"),
    )


def _run(spark, d):
    """Listings as they were resolved before, then the replay of what the verified aliases affect."""
    old, now = _aliases(spark, d, False), _aliases(spark, d, True)
    path = new_folder(spark, "replay")
    before = written(replay.resolve_fields(_listings(spark, d), old.drop("number"), VERSIONS | {"manufacturer": 2}), f"{path}/before")
    affected = replay.affected_by_aliases(before, now.where("number % 10 = 0").drop("number"))
    return replay.replay(before, affected, lambda rows: replay.resolve_fields(rows, now.drop("number"), VERSIONS), f"{path}/run", "2026-01-02", parts=2)


def replayed_listings(spark, d):
    return _run(spark, d)[0].select("listing_id", "manufacturer_id", "manufacturer", "manufacturer_status", "manufacturer_method", "normalized_model", "manufacturer_version")


def replay_events(spark, d):
    return _run(spark, d)[1].select("listing_id", "field", "previous_value", "new_value")


def _queue(spark, d):
    """Some work is queued already, in any state, a part of it for versions that have moved since."""
    p = _t(spark, d, "part").where("p_partkey % 4 = 0")
    version = lambda name, n: F.concat(F.lit(f":{name}:"), (F.col("p_partkey") % n).cast("string"))
    key = F.concat(F.lit("auto:classify_category:listing:"), F.col("p_partkey").cast("string"), F.lit(":manufacturer:3:model:2"), version("category", 20), version("identity", 7))
    return p.select(F.when(F.col("p_size") % 2 == 0, key).otherwise(F.concat(key, F.lit("0"))).alias("work_key"), F.when(F.col("p_size") % 3 == 0, "failed").when(F.col("p_size") % 3 == 1, "resolved").otherwise("pending").alias("status"))


def _behind(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        k.alias("listing_id"), (F.col("p_size") < 48).alias("is_active"), F.when(k % 50 == 1, 2).when(k % 50 == 2, F.lit(None)).otherwise(3).cast("int").alias("manufacturer_version"), F.lit(2).alias("model_version"),
        (k % 20).cast("int").alias("category_version"), (k % 7).cast("int").alias("identity_version"), (k % 11 == 0).alias("projection_required"),
    )


def stale_work(spark, d):
    return replay.stale_work(_behind(spark, d), _queue(spark, d), VERSIONS, 700)


def replay_status(spark, d):
    return replay.status(_behind(spark, d), _queue(spark, d), VERSIONS)


_BEFORE = """p AS (SELECT p_partkey AS id, p_brand AS b, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num, p_size < 48 AS active, p_partkey % 3 AS turn FROM part
  ), s AS (SELECT *, turn < 2 AND num % 5 > 0 AS was, turn < 2 AND (num % 5 > 0 OR (num % 10 = 0 AND active)) AS is_now FROM p)"""
_BEHIND = """b AS (SELECT p_partkey AS id, CASE p_partkey % 50 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS mv, p_partkey % 20 AS cv, p_partkey % 7 AS iv, p_partkey % 11 = 0 AS dirty FROM part WHERE p_size < 48
  ), q AS (SELECT 'auto:classify_category:listing:' || p_partkey || ':manufacturer:3:model:2:category:' || (p_partkey % 20) || ':identity:' || (p_partkey % 7) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '0' END AS work_key,
      CASE p_size % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'resolved' ELSE 'pending' END AS status FROM part WHERE p_partkey % 4 = 0)"""

QUERIES = {f.__name__: f for f in (replayed_listings, replay_events, stale_work, replay_status)}
ORACLES = {
    "replayed_listings": f"""WITH {_BEFORE}
  SELECT id AS listing_id, CASE WHEN is_now THEN lower(b) ELSE '' END AS manufacturer_id, CASE WHEN is_now THEN b WHEN turn = 0 THEN upper(b) ELSE '' END AS manufacturer,
    CASE WHEN is_now THEN 'resolved' WHEN turn < 2 THEN 'candidate' ELSE 'unresolved' END AS manufacturer_status,
    CASE WHEN is_now THEN CASE turn WHEN 0 THEN 'verified_alias' ELSE 'title_verified_alias' END WHEN turn < 2 THEN 'unverified_alias' ELSE 'none' END AS manufacturer_method, 'AX' || id AS normalized_model,
    CAST(CASE WHEN turn < 2 AND num % 10 = 0 AND active THEN 3 ELSE 2 END AS INTEGER) AS manufacturer_version FROM s""",
    "replay_events": f"""WITH {_BEFORE}, m AS (SELECT * FROM s WHERE is_now AND NOT was)
  SELECT id AS listing_id, 'manufacturer_id' AS field, '' AS previous_value, lower(b) AS new_value FROM m
  UNION ALL SELECT id, 'manufacturer', CASE WHEN turn = 0 THEN upper(b) ELSE '' END, b FROM m
  UNION ALL SELECT id, 'manufacturer_status', 'candidate', 'resolved' FROM m
  UNION ALL SELECT id, 'manufacturer_method', 'unverified_alias', CASE turn WHEN 0 THEN 'verified_alias' ELSE 'title_verified_alias' END FROM m""",
    "stale_work": f"""WITH {_BEHIND}, c AS (
    SELECT id, 0 AS stage, mv AS o, 'resolve_manufacturer' AS w, mv, cv, iv FROM b WHERE mv < 3 UNION ALL SELECT id, 2, cv, 'classify_category', mv, cv, iv FROM b WHERE cv < 14
    UNION ALL SELECT id, 3, iv, 'resolve_identity', mv, cv, iv FROM b WHERE iv < 5 UNION ALL SELECT id, 4, 0, 'rebuild_search_entity', mv, cv, iv FROM b WHERE dirty
  ), k AS (SELECT *, 'auto:' || w || ':listing:' || id || ':manufacturer:' || mv || ':model:2:category:' || cv || ':identity:' || iv AS work_key FROM c
  ), r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY o, id) AS n FROM k WHERE work_key NOT IN (SELECT work_key FROM q)
  ), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage) AS m FROM r WHERE n <= 700)
  SELECT id AS listing_id, w AS work_type, work_key FROM f WHERE m = 1 ORDER BY stage, o, id LIMIT 700""",
    "replay_status": f"""WITH {_BEHIND}, n AS (
    SELECT count(*) AS active_listings, count(*) FILTER (WHERE mv < 3 OR cv < 14 OR iv < 5 OR dirty) AS stale_listings, count(*) FILTER (WHERE mv < 3) AS stale_manufacturer, CAST(0 AS BIGINT) AS stale_model,
      count(*) FILTER (WHERE cv < 14) AS stale_category, count(*) FILTER (WHERE iv < 5) AS stale_identity, count(*) FILTER (WHERE dirty) AS stale_projection FROM b
  ), s AS (SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'failed') AS failed FROM q)
  SELECT n.*, s.*, stale_manufacturer + stale_model + stale_category + stale_identity + stale_projection AS stale_signals, round((active_listings - stale_listings) * 100.0 / active_listings, 2) AS progress_percent, false AS complete, failed > 0 AS blocked FROM n, s""",
}
