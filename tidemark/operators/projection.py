"""The search read model: what listings say, the entities that they make, full rebuild, sync of some listings, repair of gaps.

A sync recomputes the listings asked for together with all that share an exact identity with them, then every entity that any of
them was or is in; all else stays. A repair syncs what is broken until nothing is.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import model_spellings
from tidemark.functions.text import identity_model, nfkc
from tidemark.operators import entities
from tidemark.sources.shared import new_folder, remove, written

#: Listings whose texts an entity's search terms take.
SAMPLE = 3
#: What a projection says of a listing, and what entities take of a listing besides: as it is, and behind an underscore.
PROJECTED = ["listing_id", "manufacturer_id", "source_model", "normalized_model", "manufacturer_terms", "model_terms", "title", "category_terms"]
KEPT = ["stock_status", "price_yen", "previous_price_yen", "first_seen_at", "source_published_at", "last_activity_at"]
OWN = ["manufacturer_id", "manufacturer", "model", "primary_category_id", "title", "category"]
SAID = [c for c in PROJECTED if c not in ("listing_id", "source_model")]


@dataclass(frozen=True)
class Model:
    """listings: listing_id, shop_key, manufacturer_id, manufacturer, raw_manufacturer, model, model_status, title, category, raw_category,
    primary_category_id, search_aliases, is_active, stock_status, price_yen, previous_price_yen, first_seen_at, source_published_at, last_activity_at.
    identities: listing_id, status, catalog_product_id. catalog: catalog_product_id, manufacturer_id, canonical_model, verification_status.
    categories: catalog_product_id, category_id, is_primary. aliases: catalog_product_id, alias. makers: manufacturer_id, alias.
    projection, offers (listing_id, entity_key, shop_key) and entities are what follows from those."""

    listings: DataFrame
    identities: DataFrame
    catalog: DataFrame
    categories: DataFrame
    aliases: DataFrame
    makers: DataFrame
    projection: DataFrame | None = None
    offers: DataFrame | None = None
    entities: DataFrame | None = None


def _terms(*parts: Column) -> Column:
    """Texts and arrays of texts as one, trimmed, each once, in their order."""
    flat = F.flatten(F.array(*parts))
    return F.array_join(F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: x != "")), " ")


def project(listings: DataFrame, makers: DataFrame, *more: Column) -> DataFrame:
    """(listing_id, manufacturer_id, source_model, normalized_model, manufacturer_terms, model_terms, title, category_terms), and more of each listing."""
    c = lambda name: F.coalesce(nfkc(F.col(name).cast("string")), F.lit(""))
    known = makers.groupBy("manufacturer_id").agg(F.array_sort(F.collect_set("alias")).alias("_names"))
    rows = listings.join(known, "manufacturer_id", "left")
    one = lambda *names: F.array(*map(c, names))
    none = F.array().cast("array<string>")
    return rows.select(
        "listing_id", F.coalesce("manufacturer_id", F.lit("")).alias("manufacturer_id"), F.coalesce("model", F.lit("")).alias("source_model"),
        identity_model(c("model")).alias("normalized_model"), _terms(one("manufacturer_id", "manufacturer", "raw_manufacturer"), F.coalesce("_names", none)).alias("manufacturer_terms"),
        _terms(one("model"), F.coalesce(model_spellings("model"), none)).alias("model_terms"), F.trim(c("title")).alias("title"),
        _terms(one("category", "raw_category", "search_aliases")).alias("category_terms"), *more,
    )


def _named(listings: DataFrame) -> DataFrame:
    """listings with the names that entities.build asks for."""
    model = identity_model(F.coalesce(nfkc("model"), F.lit("")))
    return listings.select("listing_id", F.coalesce("manufacturer_id", F.lit("")).alias("manufacturer"), model.alias("model"), "model_status", F.col("primary_category_id").alias("category"), "is_active", "shop_key")


def membership(m: Model, listings: DataFrame) -> DataFrame:
    """(listing_id, entity_key, shop_key, alone) of the active ones; listings hold whole groups of one exact identity."""
    rows = _named(listings).where("is_active").join(entities.matched(m.identities, m.catalog), "listing_id", "left")
    return entities.keyed(rows, entities.exact_groups(rows.where("catalog_product_id IS NULL"))).select("listing_id", "entity_key", "shop_key", "alone")


def _given(name: str, otherwise) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), otherwise, F.lit(""))


def _texts() -> tuple[Column, Column]:
    """What search finds a listing by: title, category."""
    title = F.trim(F.concat_ws(" ", _given("_p_title", F.col("_title")), F.coalesce("_p_manufacturer_terms", F.lit("")), F.coalesce("_p_model_terms", F.lit(""))))
    return title, _given("_p_category_terms", F.col("_category"))


def _fallback() -> list[Column]:
    """What an entity is that a listing leads."""
    c = F.col
    return [
        F.lit("unresolved_listing").alias("entity_kind"), _given("_p_manufacturer_id", c("_manufacturer_id")).alias("manufacturer_id"), F.coalesce("_manufacturer", F.lit("")).alias("_own"),
        F.coalesce("_model", F.lit("")).alias("model"), F.coalesce("_p_normalized_model", F.lit("")).alias("normalized_model"), c("_primary_category_id").alias("primary_category_id"),
        _given("_p_manufacturer_terms", c("_manufacturer")).alias("manufacturer_terms"), _given("_p_model_terms", c("_model")).alias("model_terms"),
    ]


def _display() -> Column:
    return F.nullif(F.col("_manufacturer"), F.lit(""))


def _finished(out: DataFrame) -> DataFrame:
    return out.withColumn("manufacturer", F.coalesce("_display", "_own")).drop("_own", "_display").withColumnRenamed("entity_id", "entity_key")


def _grouped(m: Model, rows: DataFrame) -> DataFrame:
    """Entities of rows: entity_id, listing_id, shop_key, KEPT, _OWN, _p_SAID; the texts that go from task to task are those of each entity's first listings."""
    c = F.col
    summed = entities.aggregate(rows, F.min(_display()).alias("_display"))
    title, category = _texts()
    # the first few of each entity: cut where the rows are, then where they meet
    first = rows.select("entity_id", "listing_id", F.struct("listing_id", title.alias("title"), category.alias("category")).alias("x"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("listing_id")))
    first = first.where(c("n") <= SAMPLE).groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    said_by = lambda field: F.trim(F.array_join(F.transform("x", lambda x: x[field]), " "))
    first = first.select("entity_id", said_by("title").alias("title_terms"), said_by("category").alias("category_terms"))
    leaders = rows.where(c("entity_id") == F.concat(F.lit("l-"), c("listing_id").cast("string"))).select("entity_id", *_fallback())
    first_category = m.categories.groupBy("catalog_product_id").agg(F.min_by("category_id", F.struct(~F.coalesce(c("is_primary"), F.lit(False)), "category_id")).alias("_c"))
    names = m.aliases.groupBy("catalog_product_id").agg(F.array_sort(F.collect_set("alias")).alias("_a"))
    made = m.catalog.join(first_category, "catalog_product_id", "left").join(names, "catalog_product_id", "left")
    normal = identity_model(F.coalesce(nfkc("canonical_model"), F.lit("")))
    made = made.select(
        F.concat(F.lit("c-"), c("catalog_product_id").cast("string")).alias("entity_id"), F.lit("catalog").alias("entity_kind"), "manufacturer_id", F.lit("").alias("_own"),
        c("canonical_model").alias("model"), normal.alias("normalized_model"), F.coalesce("_c", F.lit("unclassified")).alias("primary_category_id"),
        F.trim("manufacturer_id").alias("manufacturer_terms"), F.trim(F.concat_ws(" ", "canonical_model", normal, F.array_join("_a", " "))).alias("model_terms"),
    )
    return _finished(summed.join(leaders.unionByName(made), "entity_id").join(first, "entity_id"))


def _alone(rows: DataFrame) -> DataFrame:
    """Entities of rows, as _grouped gives them, where each row is an entity of its own: nothing is shuffled."""
    c, price, stock = F.col, F.col("price_yen"), F.col("stock_status")
    title, category = _texts()
    many = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    return _finished(rows.select(
        "entity_id", F.lit(1).cast("long").alias("offer_count"), many(stock == "in_stock").alias("in_stock_offer_count"), many(stock == "sold_out").alias("sold_out_offer_count"),
        many(c("shop_key").isNotNull()).alias("shop_count"), price.alias("lowest_price_yen"), F.when(stock == "in_stock", price).alias("lowest_in_stock_price_yen"), price.alias("highest_price_yen"),
        c("last_activity_at").alias("latest_activity_at"), F.coalesce("source_published_at", "first_seen_at").alias("newest_listed_at"), many(price < c("previous_price_yen")).cast("int").alias("has_price_drop"),
        title.alias("title_terms"), F.trim(category).alias("category_terms"), _display().alias("_display"), *_fallback(),
    ))


def describe(m: Model, offers: DataFrame) -> DataFrame:
    """Entities of offers (all of an entity's or none): what they are, what their offers sum up to, and their search terms."""
    own = m.listings.select("listing_id", *KEPT, *(F.col(n).alias(f"_{n}") for n in OWN))
    said = m.projection.select("listing_id", *(F.col(n).alias(f"_p_{n}") for n in SAID))
    return _grouped(m, offers.join(own, "listing_id").join(said, "listing_id", "left").withColumnRenamed("entity_key", "entity_id"))


def rebuild(m: Model, path: str) -> Model:
    """Projection, offers and entities from listings, identities and catalog alone, each written below path before the next.

    What a listing says is taken along from the projection on, so listings meet their identities once and nothing by listing after that;
    a listing that is an entity of its own meets no other.
    """
    more = [*(F.col(n) for n in ("shop_key", "model_status", "is_active", *KEPT)), *(F.col(n).alias(f"_{n}") for n in OWN)]
    instead = {"manufacturer_id": "_manufacturer_id", "title": "_title", "category_terms": "_category"}  # where the projection says nothing
    base = written(project(m.listings, m.makers, *more), f"{path}/projection")
    m = replace(m, projection=base.select(*PROJECTED))
    active = base.where("is_active").withColumns({f"_p_{a}": _given(a, F.col(b)) for a, b in instead.items()}).drop("is_active", "source_model", "title", "category_terms", *instead.values())
    rows = written(active.join(entities.matched(m.identities, m.catalog), "listing_id", "left"), f"{path}/rows")
    named = rows.select("*", F.col("manufacturer_id").alias("manufacturer"), F.col("normalized_model").alias("model"), F.col("_primary_category_id").alias("category"))
    groups = written(entities.exact_groups(named.where("catalog_product_id IS NULL")), f"{path}/groups")
    found = entities.keyed(named.drop("category"), groups)
    m = replace(m, offers=written(found.select("listing_id", "entity_key", "shop_key"), f"{path}/offers"))
    found = found.drop("manufacturer", "model", "manufacturer_id").withColumnsRenamed({"entity_key": "entity_id", **{n: f"_p_{n}" for n in SAID if n not in instead}})
    found = found.withColumns({b: F.lit(None).cast("string") for b in instead.values()})
    m = replace(m, entities=written(_grouped(m, found.where("NOT alone")).unionByName(_alone(found.where("alone"))), f"{path}/entities"))
    remove(m.listings.sparkSession, f"{path}/rows", f"{path}/groups")
    return m


def peers(m: Model, seeds: DataFrame) -> DataFrame:
    """(listing_id) of seeds and of active listings with the exact identity of any of them."""
    named = _named(m.listings)
    keys = named.join(seeds, "listing_id", "left_semi").where("model_status = 'resolved' AND manufacturer <> '' AND model <> ''").select("manufacturer", "model").distinct()
    same = named.where("is_active AND model_status = 'resolved'").join(keys, ["manufacturer", "model"], "left_semi").select("listing_id")
    return seeds.select("listing_id").unionByName(same).distinct()


def sync(m: Model, seeds: DataFrame, path: str) -> Model:
    """The model after the seeds (listing_id), and all that shares an identity or entity with them, were computed anew.

    Its tables are written below path, which has to be a new folder; entities without offers go. What belongs where is found by ids
    and names alone; then listings, and the projection as it was, meet the ids once each, and their texts go no further than to entities of several listings."""
    spark, c = m.listings.sparkSession, F.col
    scope = written(peers(m, seeds), f"{path}/scope").withColumn("_in", F.lit(True))
    before = written(m.offers.join(scope, "listing_id", "left"), f"{path}/before")
    now = written(membership(m, m.listings.join(scope, "listing_id", "left_semi")), f"{path}/now")
    touched = written(before.where("_in").select("entity_key").unionByName(now.select("entity_key")).distinct(), f"{path}/touched")
    others = before.where("_in IS NULL").select(*m.offers.columns)
    # offers that stay as they are, of entities that don't
    beside = written(others.join(touched, "entity_key", "left_semi").select("listing_id", "entity_key", "shop_key"), f"{path}/beside")
    same = beside.where("entity_key LIKE 'l-%'").select("entity_key").distinct()
    keys = now if same.isEmpty() else now.join(same.withColumn("_same", F.lit(True)), "entity_key", "left").withColumn("alone", c("alone") & c("_same").isNull()).drop("_same")
    keys = keys.unionByName(beside.withColumn("alone", F.lit(False))).withColumnRenamed("shop_key", "_shop")
    ids = scope.unionByName(beside.select("listing_id", F.lit(False).alias("_in")))
    more = [*(c(n) for n in ("entity_key", "_shop", "alone", "_in", *KEPT)), *(c(n).alias(f"_{n}") for n in OWN)]
    base = written(project(m.listings.join(ids, "listing_id").join(keys, "listing_id", "left"), m.makers, *more), f"{path}/base")
    kept = written(m.projection.join(ids, "listing_id", "left").where("_in IS NULL OR NOT _in"), f"{path}/kept")
    rows = base.where("entity_key IS NOT NULL").withColumnsRenamed({"entity_key": "entity_id", "_shop": "shop_key", **{n: f"_p_{n}" for n in SAID}}).drop("source_model")
    said = kept.where("NOT _in").select("listing_id", *(c(n).alias(f"_p_{n}") for n in SAID))
    rows = rows.where("_in").unionByName(rows.where("NOT _in").drop(*(f"_p_{n}" for n in SAID)).join(said, "listing_id", "left"))
    found = _grouped(m, rows.where("NOT alone")).unionByName(_alone(rows.where("alone")))
    left = m.entities.join(touched, "entity_key", "left_anti").join(others.select("entity_key").distinct(), "entity_key", "left_semi")
    out = replace(
        m, projection=kept.select(*m.projection.columns).unionByName(base.where("_in").select(*m.projection.columns)),
        offers=written(others.unionByName(now.select(*m.offers.columns)), f"{path}/offers"), entities=written(left.unionByName(found.select(*m.entities.columns)), f"{path}/entities"),
    )
    remove(spark, *(f"{path}/{name}" for name in ("scope", "before", "now", "touched", "beside")))
    return out


def drift(m: Model) -> DataFrame:
    """(problem, listing_id, entity_key): everything about the read model that doesn't follow from the tables below it."""
    active = m.listings.where("is_active").select("listing_id", F.lit(True).alias("_active"))
    matched = entities.matched(m.identities, m.catalog)
    of = lambda df, problem: df.select(F.lit(problem).alias("problem"), "listing_id", "entity_key")
    nothing = F.lit(None).cast(m.listings.schema["listing_id"].dataType)
    # listings meet offers once and offers meet entities once; a row may have several problems
    met = m.offers.select("listing_id", "entity_key", F.lit(True).alias("_offer")).join(active, "listing_id", "full_outer")
    known = m.entities.select("entity_key", F.lit(True).alias("_entity"))
    alive, offer = F.coalesce("_active", F.lit(False)), F.coalesce("_offer", F.lit(False))
    # rows without an entity are dealt by their listings
    at = F.coalesce("entity_key", F.concat(F.lit("\0"), F.col("listing_id").cast("string")))
    found = met.withColumn("_at", at).join(known.select(F.col("entity_key").alias("_at"), "_entity"), "_at", "left").select(
        "listing_id", "entity_key", F.explode(F.array_compact(F.array(
            F.when(~offer, "unmembered_active_listings"), F.when(offer & ~alive, "inactive_offer_memberships"), F.when(offer & F.col("_entity").isNull(), "offers_without_entity"),
        ))).alias("problem"),
    ).select("problem", "listing_id", "entity_key")
    # counts of an entity are summed before they are shuffled
    counts = met.where("_offer").groupBy("entity_key").agg(F.count_if(alive).alias("_n"))
    checked = m.entities.join(counts, "entity_key", "left").select(
        nothing.alias("listing_id"), "entity_key", F.explode(F.array_compact(F.array(
            F.when(F.col("_n").isNull(), "entities_without_offers"), F.when(F.coalesce("_n", F.lit(0)) != F.col("offer_count"), "offer_count_mismatches"),
        ))).alias("problem"),
    ).select("problem", "listing_id", "entity_key")
    catalog = m.entities.where("entity_kind = 'catalog'")
    ids = m.catalog.where("verification_status = 'verified'").select(F.concat(F.lit("c-"), F.col("catalog_product_id").cast("string")).alias("entity_key"))
    alone = matched.select(F.concat(F.lit("l-"), F.col("listing_id").cast("string")).alias("entity_key"))
    out = found.unionByName(checked)
    out = out.unionByName(of(m.entities.where("entity_kind = 'unresolved_listing'").join(alone, "entity_key", "left_semi").withColumn("listing_id", nothing), "stale_fallback_entities"))
    return out.unionByName(of(catalog.join(ids, "entity_key", "left_anti").withColumn("listing_id", nothing), "ineligible_catalog_entities"))


def gaps(m: Model) -> DataFrame:
    """(listing_id) of active listings without an identity or without an offer."""
    active = m.listings.where("is_active").select("listing_id")
    return active.join(m.identities, "listing_id", "left_anti").unionByName(active.join(m.offers, "listing_id", "left_anti")).distinct()


def repair(m: Model, identify, most_passes: int = 8) -> tuple[Model, list[tuple[int, int, int]]]:
    """The repaired model, and (pass, listings without identity or offer, all problems) of each pass.

    identify: listings without an identity -> rows of identities. Each pass takes what drift and gaps name now: its listings, and
    those of entities that it names, are seeds of one sync; entities that have no listings go. It ends when nothing is
    left; RuntimeError if most_passes don't suffice. A pass is written to the shared folder before the next, and replaces the one before.
    """
    spark, seen, folders = m.listings.sparkSession, [], []
    for n in range(1, most_passes + 2):
        path = new_folder(spark, f"repair-{n}")
        folders.append(path)
        broken = written(drift(m), f"{path}/broken")
        # drift names the listings without an offer, so gaps need no more than those without an identity
        active = m.listings.where("is_active")
        lost = written(active.select("listing_id").join(m.identities, "listing_id", "left_anti"), f"{path}/lost")
        open_ = written(lost.unionByName(broken.where("problem = 'unmembered_active_listings'").select("listing_id")).distinct(), f"{path}/open")
        counts = open_.count(), broken.count()
        if not any(counts):
            return m, seen
        if n > most_passes:
            raise RuntimeError(f"{counts[0]} listings and {counts[1]} problems are left after {most_passes} passes")
        seen.append((n, *counts))
        found = identify(active.join(lost, "listing_id", "left_semi"))
        m = replace(m, identities=m.identities.unionByName(found.select(*m.identities.columns)))
        keys = broken.where("entity_key IS NOT NULL").select("entity_key").distinct()
        seeds = open_.unionByName(broken.where("listing_id IS NOT NULL").select("listing_id")).unionByName(m.offers.join(keys, "entity_key", "left_semi").select("listing_id"))
        m = replace(m, identities=written(m.identities, f"{path}/identities"))
        m = sync(m, seeds.distinct(), path)
        remove(spark, *folders[:-1])
    raise AssertionError
