"""Replay: what changed in aliases, products or rules reaches the listings that depend on it, once, whatever breaks off.

A run has a folder. The listings that it affects are written there first, so that a restart works on the same ones; then they are
recomputed in parts, and a part's changes and events are written before its mark. A restart does the parts without a mark
again, over what they had left. Nothing is applied twice: a run's result is its parts, laid over the listings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_space, nfkc
from tidemark.operators import manufacturers, models, remediation
from tidemark.sources.shared import exists, written

#: Stages of a listing in the order in which they are repaired, with the work that repairs them; each has a column <stage>_version.
STAGES = {"manufacturer": "resolve_manufacturer", "model": "resolve_model", "category": "classify_category", "identity": "resolve_identity"}
PROJECTION = "rebuild_search_entity"

#: What a resolution sets, and of that what events tell.
FIELDS = ["manufacturer_id", "manufacturer", "manufacturer_status", "manufacturer_method", "model", "normalized_model", "model_status", "model_method"]


def _version(stage: str) -> Column:
    return F.coalesce(F.col(f"{stage}_version"), F.lit(0))


def _stale(versions: dict[str, int]) -> dict[str, Column]:
    out = {s: _version(s) < versions[s] for s in STAGES}
    return out | {"projection": F.coalesce(F.col("projection_required"), F.lit(False))}


def stale_work(listings: DataFrame, queue: DataFrame, versions: dict[str, int], limit: int) -> DataFrame:
    """(listing_id, work_type, work_key): at most limit active listings that are behind, those of earlier stages first.

    listings: listing_id, is_active, <stage>_version for each stage, projection_required. A key holds all versions of the listing, so what is queued
    in any state is not queued again until a version moves. Every stage gives a page, most outdated listings first; a listing
    behind on several counts for the first.
    """
    key = lambda work: F.concat_ws(":", F.lit("auto"), F.lit(work), F.lit("listing"), F.col("listing_id").cast("string"), *(x for s in STAGES for x in (F.lit(s), _version(s).cast("string"))))
    known = queue.select("work_key").distinct()
    pages = []
    for i, (stage, behind) in enumerate(_stale(versions).items()):
        work = STAGES.get(stage, PROJECTION)
        order = _version(stage) if stage in STAGES else F.lit(0)
        rows = listings.where(F.col("is_active") & behind).select(F.lit(i).alias("_stage"), order.alias("_order"), "listing_id", F.lit(work).alias("work_type"), key(work).alias("work_key"))
        pages.append(rows.join(known, "work_key", "left_anti").orderBy("_order", "listing_id").limit(limit))
    rows = reduce(DataFrame.unionByName, pages)  # five pages at most
    first = rows.groupBy("listing_id").agg(F.min(F.struct("_stage", "_order", "work_type", "work_key")).alias("w"))
    return first.orderBy("w._stage", "w._order", "listing_id").limit(limit).select("listing_id", "w.work_type", "w.work_key")


def status(listings: DataFrame, queue: DataFrame, versions: dict[str, int]) -> DataFrame:
    """One row: active and stale listings, stale signals by stage, queue counts, percent done, complete, blocked (stale with failed work)."""
    stale = _stale(versions)
    any_ = reduce(lambda a, b: a | b, stale.values())
    out = listings.where("is_active").agg(F.count("*").alias("active_listings"), F.count_if(any_).alias("stale_listings"), *(F.count_if(c).alias(f"stale_{s}") for s, c in stale.items()))
    states = queue.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "resolved", "failed")))
    out = out.crossJoin(states)  # one row each
    signals = reduce(lambda a, b: a + b, (F.col(f"stale_{s}") for s in stale))
    done = F.col("active_listings") - F.col("stale_listings")
    return out.withColumns({
        "stale_signals": signals, "progress_percent": F.when(F.col("active_listings") == 0, 100.0).otherwise(F.round(done * 100 / F.col("active_listings"), 2)),
        "complete": signals == 0, "blocked": (signals > 0) & (F.col("failed") > 0),
    })


def affected_by_aliases(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(listing_id) of active listings that an alias could name: by its key, as it stands, or, without a given maker, at the start of the title.

    Titles meet aliases by equality of as many characters as aliases have; there are few such lengths.
    """
    plain = lambda c: collapse_space(nfkc(F.coalesce(F.col(c), F.lit(""))))
    names = aliases.select("alias", plain("alias").alias("_a")).where("_a <> ''").distinct()
    names = names.select(manufacturers.manufacturer_key(F.col("_a")).alias("_key"), F.lower(F.trim("alias")).alias("_word"), F.lower("_a").alias("_start"))
    rows = listings.where("is_active").select("listing_id", plain("raw_manufacturer").alias("_p"), F.lower(F.trim(F.coalesce("raw_manufacturer", F.lit("")))).alias("_word"), F.lower(plain("title")).alias("_title"))
    rows = rows.withColumn("_key", manufacturers.manufacturer_key(F.col("_p")))
    lengths = sorted(r[0] for r in names.select(F.length("_start")).distinct().collect())
    by_key = rows.where("_key <> ''").join(names.select("_key").distinct(), "_key", "left_semi")
    by_word = rows.where("_word <> ''").join(names.select("_word").distinct(), "_word", "left_semi")
    starts = F.array(*(F.substring("_title", 1, n) for n in lengths))
    by_title = rows.where("_word = ''").select("listing_id", F.explode(F.array_distinct(starts)).alias("_start")).join(names.select("_start").distinct(), "_start", "left_semi")
    return reduce(DataFrame.unionByName, (x.select("listing_id") for x in (by_key, by_word, by_title))).distinct()


def affected_by_products(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(listing_id) of active listings that are matched to a product or bear its identity. products: catalog_product_id, manufacturer_id, normalized_model."""
    active = listings.where("is_active")
    matched = active.join(products.select("catalog_product_id").distinct(), "catalog_product_id", "left_semi").select("listing_id")
    same = active.join(products.select("manufacturer_id", "normalized_model").distinct(), ["manufacturer_id", "normalized_model"], "left_semi").select("listing_id")
    return matched.unionByName(same).distinct()


def affected_by_version(listings: DataFrame, stage: str, version: int) -> DataFrame:
    """(listing_id) of active listings that an older version of a stage decided, or that wait for their projection."""
    return listings.where(F.col("is_active") & ((_version(stage) < version) | F.coalesce(F.col("projection_required"), F.lit(False)))).select("listing_id")


def resolve_fields(listings: DataFrame, aliases: DataFrame, versions: dict[str, int]) -> DataFrame:
    """listings with maker and model resolved anew, in that order, their versions set and their projection asked for.

    listings: listing_id, raw_manufacturer, manufacturer_candidate, title, raw_model, and all FIELDS."""
    maker = manufacturers.resolve(listings, aliases).select("listing_id", F.col("manufacturer_id").alias("_id"), F.col("display_name").alias("_name"), F.col("status").alias("_status"), F.col("method").alias("_method"))
    rows = listings.join(maker, "listing_id")
    known = aliases.where("verification_status = 'verified'").select("manufacturer_id", "alias").distinct()
    named = rows.select("listing_id", F.col("_id").alias("manufacturer_id"), "raw_model", "title")
    model = models.resolve(named, known).select("listing_id", F.col("model").alias("_model"), F.col("normalized_model").alias("_normal"), F.col("status").alias("_m_status"), F.col("method").alias("_m_method"))
    rows = rows.join(model, "listing_id")
    new = dict(zip(FIELDS, (F.col("_id"), F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("manufacturer")), F.col("_status"), F.col("_method"), F.col("_model"), F.col("_normal"), F.col("_m_status"), F.col("_m_method"))))
    new |= {"manufacturer_version": F.lit(versions["manufacturer"]), "model_version": F.lit(versions["model"]), "projection_required": F.lit(True)}
    return rows.select([new[c].alias(c) if c in new else F.col(c) for c in listings.columns])


def replay(listings: DataFrame, affected: DataFrame, resolve: Callable[[DataFrame], DataFrame], path: str, at: str, fields: list[str] = FIELDS, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(listings after the run, its events), from the run's folder at path, which a restart has to name again.

    resolve: some listings -> the same rows, recomputed. Events: event_key, listing_id, field, previous_value, new_value, at, one for each field of a
    listing that moved; event_key is the same whenever the same run makes it.
    """
    spark = listings.sparkSession
    if not exists(spark, f"{path}/affected/_SUCCESS"):
        split = affected.select("listing_id").distinct().withColumn("part", F.pmod(F.xxhash64("listing_id"), F.lit(parts)).cast("int"))
        split.write.mode("overwrite").partitionBy("part").parquet(f"{path}/affected")
    kind = listings.schema["listing_id"].dataType.simpleString()
    split = spark.read.schema(f"listing_id {kind}, part int").parquet(f"{path}/affected")
    for k in range(parts):
        if exists(spark, f"{path}/done/part={k}/_SUCCESS"):
            continue
        before = listings.join(split.where(F.col("part") == k), "listing_id", "left_semi")
        after = written(resolve(before).select(*listings.columns), f"{path}/changes/replayed_part={k}")
        moved = remediation.provenance(before, after, "listing_id", fields, at)
        key = F.sha2(F.concat_ws(":", F.lit(path.rsplit("/", 1)[-1]), F.col("listing_id").cast("string"), "field"), 256)
        moved.select(key.alias("event_key"), *moved.columns).write.mode("overwrite").parquet(f"{path}/events/part={k}")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done/part={k}")
    changes = spark.read.parquet(f"{path}/changes").select(*listings.columns)
    events = spark.read.parquet(f"{path}/events").drop("part")
    return listings.join(changes.select("listing_id"), "listing_id", "left_anti").unionByName(changes), events


def sweep(listings: DataFrame, queue: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], versions: dict[str, int], path: str, at: str, limit: int, fields: list[str] = FIELDS, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """One tick: queue stale work, take all that waits, replay it by its step, settle it. (listings, queue) after it; events are in the folders of the steps.

    queue: listing_id, work_type, work_key, status, attempt_count. steps: work type -> listings -> the same rows, recomputed. Work whose listing is still
    behind on its stage after its step stays pending, and fails at the third attempt; work without a step fails.
    """
    spark = listings.sparkSession
    new = stale_work(listings, queue, versions, limit).select("listing_id", "work_type", "work_key", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"))
    queue = written(queue.unionByName(new.select(*queue.columns)), f"{path}/queue")
    taken = queue.where("status = 'pending'")
    for work, step in steps.items():
        listings, _ = replay(listings, taken.where(F.col("work_type") == work), step, f"{path}/{work}", at, fields, parts)
    listings = written(listings, f"{path}/listings")
    behind = F.coalesce(*(F.when(F.col("work_type") == STAGES.get(s, PROJECTION), c) for s, c in _stale(versions).items()), F.lit(True))
    left = taken.join(listings, "listing_id", "left").select("work_key", F.coalesce(behind | ~F.col("work_type").isin(list(steps)), F.lit(True)).alias("_left"))
    out = queue.join(left, "work_key", "left")
    tries = F.col("attempt_count") + F.when(F.col("_left").isNotNull(), 1).otherwise(0)
    state = F.when(F.col("_left").isNull(), F.col("status")).when(~F.col("_left"), "resolved").when(tries >= 3, "failed").otherwise("pending")
    out = out.withColumns({"status": state, "attempt_count": tries}).select(*queue.columns)
    return listings, written(out, f"{path}/settled")
