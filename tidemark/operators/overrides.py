"""Corrections by people as the last layer: laid over what resolvers found, never stored in it, so a correction outlives every fold and its removal shows the found value again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a correction of a field settles too (fixed values).
SETTLED = {
    "manufacturer_id": {"manufacturer_status": "resolved", "manufacturer_method": "admin_override"},
    "model": {"model_status": "resolved", "model_method": "admin_override"},
    "primary_category_id": {"classification_status": "classified", "classification_source": "admin_override"},
}


def latest(overrides: DataFrame) -> DataFrame:
    """(listing_id, field, value, version) that hold now: of each field's versions the last; one with a null value takes the correction back.

    overrides: listing_id, field, value, version; of equal versions the larger value holds."""
    last = overrides.groupBy("listing_id", "field").agg(F.max(F.struct("version", "value")).alias("o"))
    return last.where("o.value IS NOT NULL").select("listing_id", "field", "o.value", "o.version")


def effective(listings: DataFrame, overrides: DataFrame, fields: list[str], settled: dict[str, dict[str, str]] = SETTLED) -> DataFrame:
    """listings with corrected fields (cast to their types) and the columns that a correction settles; columns that aren't there are left out."""
    now = latest(overrides.where(F.col("field").isin(fields)))
    wide = now.groupBy("listing_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_o_{f}") for f in fields))
    out = listings.join(wide, "listing_id", "left")
    new = {f: F.coalesce(F.col(f"_o_{f}").cast(listings.schema[f].dataType), F.col(f)) for f in fields}
    for f in fields:
        for name, value in settled.get(f, {}).items():
            if name in listings.columns:
                new[name] = F.when(F.col(f"_o_{f}").isNotNull(), value).otherwise(new.get(name, F.col(name)))
    return out.select([new.get(c, F.col(c)).alias(c) for c in listings.columns])


def overridden(listings: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """(listing_id, field, found, corrected, version): what corrections hide, where they differ from it."""
    found = listings.select("listing_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("found")) for f in fields))).alias("x")).select("listing_id", "x.*")
    out = found.join(latest(overrides).withColumnRenamed("value", "corrected"), ["listing_id", "field"])
    return out.where(~F.col("found").eqNullSafe(F.col("corrected"))).select("listing_id", "field", "found", "corrected", "version")
