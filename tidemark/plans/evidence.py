"""The evidence archive on the driver's tables, with its DuckDB SQL: an event is a page that a shop's crawl wants to keep.

Days have a pause at midnight and pages name their day, so the SQL can take days apart, one object after the other in each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import evidence

from .listings import _t

LIMITS = evidence.Limits(object_bytes=30, day_objects=60, day_bytes=1500, shop_day_objects=4, burst_minutes=15, burst_objects=1, sample=3)


def evidence_archive(spark, d):
    """Each event's fate: archived, deduplicated, suppressed by which cap, or skipped."""
    e = _t(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    day = F.to_date(at)
    seconds = F.unix_micros(at) - F.unix_micros(day.cast("timestamp"))
    reason = F.when(F.col("event_type") == "error", "parser_failure").when(F.col("event_type") == "view", "unknown_category").when(F.col("event_type") == "click", "product_content_changed").otherwise("none of these")
    objects = e.select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("event_id"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("shop_key"), reason.alias("reason"),
        F.concat_ws(" ", F.lit("page"), day.cast("string"), F.repeat(F.lit("x"), (F.col("value") % 25).cast("int"))).alias("html"),
        F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.floor(seconds / 4) + F.lit(6 * 3_600_000_000)).alias("captured_at"),
    )
    out = evidence.decide(objects, limits=LIMITS)
    return out.select("event_id", "status", F.coalesce("why", F.lit("")).alias("why"), F.coalesce("content_bytes", F.lit(0)).cast("long").alias("content_bytes"))


QUERIES = {"evidence_archive": evidence_archive}
ORACLES = {
    "evidence_archive": f"""WITH RECURSIVE e AS (
    SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, 's' || (user_id % 40) AS shop, CASE event_type WHEN 'error' THEN 'parser_failure' WHEN 'view' THEN 'unknown_category' WHEN 'click' THEN 'product_content_changed' END AS reason,
      substr('page ' || CAST(CAST(ts AS DATE) AS VARCHAR) || ' ' || repeat('x', CAST(floor(value % 25) AS INTEGER)), 1, {LIMITS.object_bytes}) AS body, CAST(ts AS DATE) AS d,
      (epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) // 4 AS t FROM events WHERE ts IS NOT NULL
  ), s AS (SELECT *, sha256(body) AS h, CAST(strlen(body) AS BIGINT) AS b, row_number() OVER (PARTITION BY d ORDER BY t, event_id) AS n FROM e WHERE reason IS NOT NULL
  ), r AS (
    SELECT DISTINCT d, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(shop VARCHAR, reason VARCHAR, h VARCHAR, t BIGINT, b BIGINT)[]) AS kept, '' AS event_id, '' AS why FROM s
    UNION ALL
    SELECT d, n, CASE WHEN why = '' THEN list_append(kept, {{'shop': shop, 'reason': reason, 'h': h, 't': t, 'b': b}}) ELSE kept END, event_id, why FROM (
      SELECT s.d, s.n, r.kept, s.event_id, s.shop, s.reason, s.h, s.t, s.b, CASE
        WHEN len(list_filter(r.kept, lambda k: k.shop = s.shop AND k.reason = s.reason AND k.h = s.h)) > 0 THEN 'again'
        WHEN len(r.kept) >= {LIMITS.day_objects} THEN 'daily_object_cap'
        WHEN coalesce(list_sum(list_transform(r.kept, lambda k: k.b)), 0) + s.b > {LIMITS.day_bytes} THEN 'daily_byte_cap'
        WHEN len(list_filter(r.kept, lambda k: k.shop = s.shop)) >= {LIMITS.shop_day_objects} THEN 'shop_daily_object_cap'
        WHEN len(list_filter(r.kept, lambda k: k.shop = s.shop AND k.reason = s.reason AND k.t >= s.t - {LIMITS.burst_minutes * 60_000_000})) >= {LIMITS.burst_objects} AND CAST('0x' || substr(s.h, 1, 8) AS BIGINT) % {LIMITS.sample} <> 0 THEN 'burst_sampled'
        ELSE '' END AS why
      FROM r JOIN s ON s.d = r.d AND s.n = r.n + 1)
  )
  SELECT e.event_id, CASE WHEN r.why IS NULL THEN 'skipped' WHEN r.why = '' THEN 'archived' WHEN r.why = 'again' THEN 'deduplicated' ELSE 'suppressed' END AS status,
    CASE WHEN r.why IS NULL OR r.why = 'again' THEN '' ELSE r.why END AS why, CASE WHEN r.why IS NULL THEN 0 ELSE CAST(strlen(body) AS BIGINT) END AS content_bytes FROM e LEFT JOIN r ON r.event_id = e.event_id"""
}
