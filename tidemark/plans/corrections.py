"""Corrections by people, and the resumable export, on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import overrides
from tidemark.sources import export
from tidemark.sources.shared import new_folder

from .listings import _t

FIELDS = ["manufacturer_id", "model", "primary_category_id"]


def _tables(spark, d):
    p = _t(spark, d, "part")
    listings = p.select(
        F.col("p_partkey").alias("listing_id"), F.lower("p_brand").alias("manufacturer_id"), F.lit("candidate").alias("manufacturer_status"), F.col("p_name").alias("model"), F.lit("seller_model").alias("model_method"),
        F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).alias("primary_category_id"),
    )
    o = _t(spark, d, "orders").where("o_custkey % 3 = 0")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return listings, o.select(F.col("o_custkey").alias("listing_id"), field.alias("field"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("by hand "), F.col("o_orderkey").cast("string"))).alias("value"), F.col("o_orderkey").alias("version"))


def corrected_listings(spark, d):
    return overrides.effective(*_tables(spark, d), FIELDS)


def corrected_fields(spark, d):
    return overrides.overridden(*_tables(spark, d), FIELDS)


def export_chunks(spark, d):
    """Customers as chunks, by a worker that stops after its first part and one that goes on."""
    c = _t(spark, d, "customer").where("c_custkey % 7 > 0").select("c_custkey", "c_name", "c_mktsegment")
    path = new_folder(spark, "export")
    export.export(c, path, "c_custkey", 100, 2, most_parts=1)
    out = export.export(c, path, "c_custkey", 100, 2)
    return out.select("chunk", "row_count", "first_key", "last_key", F.sha2("body", 256).alias("body_sha256"))


_LATEST = """o AS (
    SELECT o_custkey AS listing_id, ['manufacturer_id', 'model', 'primary_category_id'][o_orderkey % 3 + 1] AS field, CASE WHEN o_orderstatus <> 'P' THEN 'by hand ' || o_orderkey END AS value, o_orderkey AS version FROM orders WHERE o_custkey % 3 = 0
  ), n AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY listing_id, field ORDER BY version DESC) = 1), l AS (SELECT * FROM n WHERE value IS NOT NULL),
  p AS (SELECT p_partkey AS listing_id, lower(p_brand) AS manufacturer_id, p_name AS model, CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS primary_category_id FROM part)"""

QUERIES = {f.__name__: f for f in (corrected_listings, corrected_fields, export_chunks)}
ORACLES = {
    "corrected_listings": f"""WITH {_LATEST} SELECT p.listing_id, coalesce(a.value, manufacturer_id) AS manufacturer_id, CASE WHEN a.value IS NULL THEN 'candidate' ELSE 'resolved' END AS manufacturer_status, coalesce(b.value, model) AS model,
    CASE WHEN b.value IS NULL THEN 'seller_model' ELSE 'admin_override' END AS model_method, coalesce(c.value, primary_category_id) AS primary_category_id
  FROM p LEFT JOIN l AS a ON a.listing_id = p.listing_id AND a.field = 'manufacturer_id' LEFT JOIN l AS b ON b.listing_id = p.listing_id AND b.field = 'model' LEFT JOIN l AS c ON c.listing_id = p.listing_id AND c.field = 'primary_category_id'""",
    "corrected_fields": f"""WITH {_LATEST}, f AS (SELECT listing_id, 'manufacturer_id' AS field, manufacturer_id AS found FROM p UNION ALL SELECT listing_id, 'model', model FROM p UNION ALL SELECT listing_id, 'primary_category_id', primary_category_id FROM p)
  SELECT listing_id, field, found, value AS corrected, version FROM f JOIN l USING (listing_id, field) WHERE found IS DISTINCT FROM value""",
    "export_chunks": """WITH c AS (SELECT c_custkey, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || replace(c_mktsegment, '"', '""') || '",""' || chr(13) || chr(10) AS line, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS chunk FROM customer WHERE c_custkey % 7 > 0)
  SELECT chunk, count(*) AS row_count, min(c_custkey) AS first_key, max(c_custkey) AS last_key,
    sha256(CASE WHEN chunk = 0 THEN chr(65279) || '"c_custkey","c_name","c_mktsegment","csv_fields_truncated"' || chr(13) || chr(10) ELSE '' END || string_agg(line, '' ORDER BY c_custkey)) AS body_sha256 FROM c GROUP BY chunk""",
}
