import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions.identity import MOST, parts, spellings
from tidemark.operators import projection
from tidemark.sources.shared import finished, new_folder

LISTING = (
    "listing_id long, shop_key string, manufacturer_id string, manufacturer string, raw_manufacturer string, model string, model_status string, title string, category string, raw_category string, "
    "primary_category_id string, search_aliases string, is_active boolean, stock_status string, price_yen long, previous_price_yen long, first_seen_at timestamp, source_published_at timestamp, last_activity_at timestamp"
)


def test_spellings_of_models():
    assert parts("D-1000 MKII") == parts("D1000 mk2") == parts("Ｄ－1000 MARK II") == ("D1000", ("MK2",))
    assert parts("D-1000 Mk III Limited Edition") == ("D1000", ("MK3", "LIMITED")) and parts("AMP II") == ("AMP", ("REV2",))
    assert parts("C1X") == ("C1", ("X",)) and parts("MAX") == ("MAX", ()) and parts("PRO") == ("PRO", ()) and parts("805 D4 Signature") == ("805D4", ("SIGNATURE",))
    assert parts(None) == parts("プリ") == ("", ()) and spellings(None) == []
    assert spellings("D-1000 MKII") == ["D1000MK2", "D1000 MK2", "D1000MKII", "D-1000 MK2", "D1000 MKII", "D-1000 MKII"]
    assert spellings("ls50") == ["LS50", "LS-50"] and all(len(spellings(n)) <= MOST for n in ("A-1 MK2 SE PRO TX Limited Edition", "x"))


def listings(rng, ids):
    at = dt.datetime(2026, 1, 1)
    return [
        (
            i, f"s{rng.randrange(3)}", rng.choice(["tad", "lux", "", None]), rng.choice(["TAD", "", None]), "raw", rng.choice(["D-1000 MKII", "D1000MK2", "L-507", "L 507", "?", None]), rng.choice(["resolved", "resolved", "candidate"]),
            f"title {i}", "cat", None, rng.choice(["dac", "other", "other", "unclassified"]), None, rng.random() < 0.8, rng.choice(["in_stock", "sold_out", "unknown"]), rng.choice([None, 100, 200]), 150, at, None, at + dt.timedelta(i),
        )
        for i in ids
    ]


def tables(spark, rows, hits):
    frame = spark.createDataFrame(rows, LISTING)
    ids = spark.createDataFrame([(r[0], *hits.get(r[0], ("unresolved", None))) for r in rows], "listing_id long, status string, catalog_product_id long")
    catalog = spark.createDataFrame([(1, "tad", "D1000MK2", "verified"), (2, "lux", "L-507", "verified"), (3, "lux", "L-1", "rejected")], "catalog_product_id long, manufacturer_id string, canonical_model string, verification_status string")
    kinds = spark.createDataFrame([(1, "dac", False), (1, "amp", False), (2, "dac", False), (2, "rack", True)], "catalog_product_id long, category_id string, is_primary boolean")
    names = spark.createDataFrame([(1, "D-1000"), (1, "B alias")], "catalog_product_id long, alias string")
    makers = spark.createDataFrame([("tad", "ティーエーディー"), ("tad", "TAD")], "manufacturer_id string, alias string")
    return projection.Model(frame, ids, catalog, kinds, names, makers)


def same(a, b):
    for name, key in (("projection", "listing_id"), ("offers", "listing_id"), ("entities", "entity_key")):
        x, y = getattr(a, name), getattr(b, name)
        if name == "projection":  # what became inactive keeps the projection that it had
            x = x.join(b.listings.where("is_active").select("listing_id"), "listing_id", "left_semi")
            y = y.join(b.listings.where("is_active").select("listing_id"), "listing_id", "left_semi")
        assert sorted(map(str, x.select(*y.columns).orderBy(key).collect())) == sorted(map(str, y.orderBy(key).collect())), name


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(4)
    rows = listings(rng, range(40))
    hits = {i: ("matched", rng.choice([1, 2, 3])) for i in range(0, 40, 6)}
    m = tables(spark, rows, hits)
    return rows, hits, projection.rebuild(m, new_folder(spark, "t"))


def test_entities_of_both_kinds(built):
    rows, hits, m = built
    e = {r.entity_key: r for r in m.entities.collect()}
    offers = {r.listing_id: r.entity_key for r in m.offers.collect()}
    assert set(offers) == {r[0] for r in rows if r[12]} and set(e) == set(offers.values())
    assert {k for k, v in offers.items() if v.startswith("c-")} == {i for i, (_, p) in hits.items() if p != 3 and i in offers}
    c = e.get("c-2") or e["c-1"]
    assert (e["c-2"].primary_category_id, e["c-2"].normalized_model) == ("rack", "L507") and c.entity_kind == "catalog"
    if "c-1" in e:
        assert e["c-1"].primary_category_id == "amp" and e["c-1"].model_terms == "D1000MK2 D1000MK2 B alias D-1000"
    groups = {}
    for r in rows:
        key = (r[2], "".join(x for x in (r[5] or "").upper().replace("MKII", "MK2") if x.isalnum() and x.isascii()))
        if r[12] and r[6] == "resolved" and key[0] and key[1] and not offers[r[0]].startswith("c-"):
            groups.setdefault(key, []).append(r)
    assert groups
    for g in groups.values():
        apart = len({r[10] for r in g} - {"other", "unclassified"}) > 1
        assert {offers[r[0]] for r in g} == ({f"l-{r[0]}" for r in g} if apart else {f"l-{min(r[0] for r in g)}"})
    some = next(r for r in m.projection.collect() if r.manufacturer_id == "tad" and r.source_model == "D-1000 MKII")
    assert some.model_terms.startswith("D-1000 MKII D1000MK2 ") and "ティーエーディー" in some.manufacturer_terms.split()


def test_sync_of_changed_listings_equals_rebuild(spark, built):
    rows, hits, m = built
    rng = random.Random(7)
    changed = listings(rng, [2, 3, 5, 8, 12, 13, 40, 41])
    now = {r[0]: r for r in rows} | {r[0]: r for r in changed}
    more = hits | {5: ("matched", 1), 12: ("unresolved", None), 41: ("matched", 2)}
    fresh = tables(spark, list(now.values()), more)
    seeds = spark.createDataFrame([(r[0],) for r in changed], "listing_id long")
    # peers of what listings were before have to be asked for too
    old = projection.peers(m, seeds)
    got = projection.sync(replace(m, listings=fresh.listings, identities=fresh.identities), old, new_folder(spark, "t"))
    want = projection.rebuild(fresh, new_folder(spark, "t"))
    same(got, want)
    assert projection.drift(got).count() == 0


def test_repair_ends_at_the_rebuilt_model(spark, built):
    rows, hits, m = built
    broken = replace(
        m, identities=m.identities.where("listing_id % 4 > 0"), offers=m.offers.where("listing_id % 5 > 0"),
        entities=m.entities.where("entity_key <> 'c-2'").withColumn("offer_count", F.when(F.col("entity_key") == "c-1", 99).otherwise(F.col("offer_count"))),
    )
    asked = []

    def identify(lost):
        asked.append(sorted(r.listing_id for r in lost.collect()))
        return m.identities.join(lost.select("listing_id"), "listing_id", "left_semi")

    got, passes = projection.repair(broken, identify)
    same(got, m)
    assert [n for n, *_ in passes] == list(range(1, len(passes) + 1)) and passes[0][1] > 0 and passes[0][2] > 0
    assert asked[0] == [r[0] for r in rows if r[12] and r[0] % 4 == 0]
    again, none = projection.repair(got, identify)
    assert none == [] and again.entities is got.entities
    with pytest.raises(RuntimeError, match="are left after 1 passes"):
        projection.repair(broken, lambda lost: m.identities.limit(0), most_passes=1)


def test_drift_names_each_problem(spark, built):
    _, _, m = built
    counted = lambda x: {r.problem: r["count"] for r in projection.drift(x).groupBy("problem").count().collect()}
    assert counted(m) == {}
    n = m.entities.where("entity_kind = 'catalog'").count()
    assert counted(replace(m, catalog=m.catalog.withColumn("verification_status", F.lit("rejected")))) == {"ineligible_catalog_entities": n}
    lead = m.entities.where("entity_kind = 'unresolved_listing'").first().entity_key
    now = m.identities.withColumn("status", F.when(F.concat(F.lit("l-"), "listing_id") == lead, "matched").otherwise(F.col("status"))).withColumn("catalog_product_id", F.coalesce("catalog_product_id", F.lit(1)))
    assert counted(replace(m, identities=now))["stale_fallback_entities"] == 1
    gone = m.offers.where(F.col("entity_key") != lead)
    found = counted(replace(m, offers=gone))
    assert found["entities_without_offers"] == found["offer_count_mismatches"] == 1 and found["unmembered_active_listings"] == m.offers.count() - gone.count()
    assert counted(replace(m, entities=m.entities.where(F.col("entity_key") != lead))) == {"offers_without_entity": m.offers.count() - gone.count()}


def test_rebuild_meets_identities_once(spark, built, monkeypatch):
    rows, hits, _ = built
    plans, keep = [], projection.written

    def watched(df, path):
        plans.append((path.rsplit("/", 1)[-1], df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, path)

    monkeypatch.setattr(projection, "written", watched)
    m = projection.rebuild(tables(spark, rows, hits), new_folder(spark, "t"))
    by_listing = {name: [x for x in plan.splitlines() if " Join " in f" {x} " and "(listing_id" in x] for name, plan in plans}
    assert sum(map(len, by_listing.values())) == len(by_listing["rows"]) == 1
    # entities are the same as those that join everything by listing
    again = projection.describe(m, m.offers)
    assert sorted(map(str, again.select(*m.entities.columns).collect())) == sorted(map(str, m.entities.collect()))


def test_drift_finds_rows_with_two_problems(spark, built):
    _, _, m = built
    offers = m.offers.unionByName(spark.createDataFrame([(99, "l-99", "s"), (98, None, "s")], m.offers.schema))
    found = sorted((r.problem, r.listing_id, r.entity_key) for r in projection.drift(replace(m, offers=offers)).where("listing_id > 90").na.fill("none").collect())
    assert found == [(p, i, k) for p in ("inactive_offer_memberships", "offers_without_entity") for i, k in ((98, "none"), (99, "l-99"))]


def test_rebuild_leaves_its_tables_only(spark, built):
    rows, hits, _ = built
    path = new_folder(spark, "t")
    projection.rebuild(tables(spark, rows, hits), path)
    assert finished(spark, path) == ["entities", "offers", "projection"]


def test_sync_reads_texts_of_listings_once(spark, built, monkeypatch):
    """Entities come from what was projected, not from another join of listings and projection; offers of an entity outside of the scope keep what is stored."""
    rows, hits, m = built
    plans, keep = {}, projection.written

    def watched(df, path):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, path)

    monkeypatch.setattr(projection, "written", watched)
    product = m.offers.where("entity_key LIKE 'c-%'").groupBy("entity_key").count().orderBy(F.desc("count"), "entity_key").first()
    assert product["count"] > 1
    seed = m.offers.where(F.col("entity_key") == product.entity_key).orderBy("listing_id").limit(1).select("listing_id")
    got = projection.sync(m, seed, new_folder(spark, "t"))
    same(got, m)
    assert "raw_category#" not in plans["entities"]
    assert sum("raw_category#" in plan and "search_aliases#" in plan.split("LogicalRDD")[0] for plan in plans.values()) == 1


def test_sync_of_a_lone_listing_that_another_offer_points_at(spark, built):
    """An offer outside of the scope that stands in a lone listing's entity is counted with it."""
    _, _, m = built
    found = {r.entity_key: r["count"] for r in m.offers.groupBy("entity_key").count().collect()}
    lone = next(r for r in m.offers.where("entity_key LIKE 'l-%'").orderBy("listing_id").collect() if found[r.entity_key] == 1)
    other = m.offers.where("entity_key LIKE 'c-%'").orderBy("listing_id").first()
    moved = F.when(F.col("listing_id") == other.listing_id, lone.entity_key).otherwise(F.col("entity_key"))
    got = projection.sync(replace(m, offers=m.offers.withColumn("entity_key", moved)), spark.createDataFrame([(lone.listing_id,)], "listing_id long"), new_folder(spark, "t"))
    assert {r.entity_key: r.offer_count for r in got.entities.collect()}[lone.entity_key] == 2
