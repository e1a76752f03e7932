"""Repair of stored results: goals, what changed, superseded work, inventory checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import worst

#: Goals of each rate (fixed values): the bound, how it compares, and whether a miss is structural.
GOALS = {
    "manufacturer_unknown": (0.1, "lt", False),
    "category_unclassified": (0.1, "lt", False),
    "identity_coverage": (1.0, "eq", True),
    "identity_unresolved": (0.5, "lt", False),
    "inventory_unknown": (0.05, "lt", False),
    "model_missing": (0.05, "lt", False),
    "evidence_coverage": (0.95, "gt", False),
}


def slo(rates: DataFrame, goals: dict = GOALS) -> DataFrame:
    """Adds <name>_status for each goal, structural_status, source_status and status. rates has a column of each goal's name.

    A rate that is null or no number is unknown; a miss is a warning, a structural one critical.
    """
    def status(name: str) -> Column:
        target, how, structural = goals[name]
        v = F.when(~F.isnan(name), F.col(name).cast("double"))
        met = {"lt": v < target, "gt": v > target, "eq": v == target}[how]
        return F.when(v.isNull(), "unknown").when(met, "healthy").otherwise("critical" if structural else "warning")

    out = rates.withColumns({f"{g}_status": status(g) for g in goals})
    groups = {"structural_status": [g for g in goals if goals[g][2]], "source_status": [g for g in goals if not goals[g][2]], "status": list(goals)}
    return out.withColumns({n: worst(*(F.col(f"{g}_status") for g in gs)) for n, gs in groups.items()})


def provenance(before: DataFrame, after: DataFrame, key: str, fields: list[str], at: str) -> DataFrame:
    """(key, field, previous_value, new_value, at): what a run changed, from the two states, null-safe. New and gone rows change nothing."""
    old = before.select(key, *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
    pairs = old.join(after.select(key, *(F.col(f).cast("string").alias(f) for f in fields)), key)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("previous_value"), F.col(f).alias("new_value")) for f in fields))
    changed = F.filter(rows, lambda x: ~x.previous_value.eqNullSafe(x.new_value))
    return pairs.select(key, F.inline(changed)).withColumn("at", F.lit(at).cast("timestamp"))


def identity_sync(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found that must be written: new or different in status, method or product. Both: listing_id and those three."""
    values = ["status", "method", "catalog_product_id"]
    old = stored.select("listing_id", F.struct(*values).alias("_old"))
    rows = found.join(old, "listing_id", "left")
    same = F.col("_old").isNotNull() & F.struct(*values).eqNullSafe(F.col("_old"))
    return rows.where(~same).drop("_old")


def method_distribution(listings: DataFrame, identities: DataFrame, n: int = 50) -> DataFrame:
    """Active listings and shops by identity status and method; a listing without identity is missing."""
    rows = listings.where("is_active").join(identities.select("listing_id", "status", "method"), "listing_id", "left")
    method = F.when(F.coalesce("method", F.lit("")) == "", "missing").otherwise(F.col("method"))
    out = rows.groupBy(F.coalesce("status", F.lit("missing")).alias("status"), method.alias("method"))
    return out.agg(F.count_distinct("listing_id").alias("listings"), F.count_distinct("shop_key").alias("shops")).orderBy(F.desc("listings"), "status", "method").limit(n)


def superseded(queue: DataFrame, listings: DataFrame, versions: dict[str, int], now: str) -> DataFrame:
    """Automatic work that nobody owes any more, as resolved rows: its listing is inactive, or clean and at the current version.

    queue: id, listing_id, work_type, status, automatic, lease_expires_at. listings: listing_id, is_active, dirty and a column
    <work_type>_version for each of versions. Work under a live lease is left alone.
    """
    at = F.lit(now).cast("timestamp")
    free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= at)))
    work = queue.where(free & F.col("automatic") & F.col("work_type").isin(*versions, "rebuild_search_entity"))
    current = F.col("work_type") == "rebuild_search_entity"
    for kind, version in versions.items():
        current = current | ((F.col("work_type") == kind) & (F.coalesce(f"{kind}_version", F.lit(0)) >= version))
    facts = listings.select("listing_id", "is_active", "dirty", *(f"{k}_version" for k in versions))
    done = work.join(facts, "listing_id").where(~F.col("is_active") | (~F.col("dirty") & current))
    return done.select(*queue.columns).withColumns({"status": F.lit("resolved"), "lease_expires_at": F.lit(None).cast("timestamp"), "resolved_at": at})


def recheck(checks: DataFrame, threshold: int = 2) -> DataFrame:
    """Outcome of an inventory check of each listing: `available` resets, `unavailable` counts, at the threshold the listing goes.

    checks: listing_id, available, failures, checked_at, last_seen_at. Failures before the listing was last seen don't count.
    """
    void = F.col("checked_at").isNull() | F.coalesce(F.col("last_seen_at") > F.col("checked_at"), F.lit(False))
    n = F.when(F.col("available"), 0).otherwise(F.when(void, 0).otherwise(F.greatest(F.coalesce("failures", F.lit(0)), F.lit(0))) + 1)
    gone = n >= threshold
    outcome = F.when(F.col("available"), "available").when(gone, "deactivated").otherwise("retry")
    return checks.select("listing_id", n.cast("long").alias("failures"), outcome.alias("outcome"))
