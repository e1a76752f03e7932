import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog_match as cm
from tidemark.operators import resolution

PRODUCT = "product_id long, manufacturer_id string, canonical_model string, normalized_model string, verification_status string"
LISTING = "listing_id long, manufacturer_id string, model string, model_status string"


@pytest.mark.parametrize("maker,model,names", [
    ("denon", "PMA-1700NE-SP", ["PMA-1700NE", "PMA-1700NE-SP"]), ("denon", "AH-D5200EM", ["AH-D5200", "AH-D5200EM"]), ("denon", "XYZ-1-SP", ["XYZ-1-SP"]), ("tad", "PMA-1-SP", ["PMA-1-SP"]),
    ("marantz", "sacd10/FB", ["SACD10", "SACD 10", "SACD10/FB"]), ("Marantz ", "MODEL 40n", ["MODEL 40N"]), ("x", "《特価》 D – 1000  MK II (黒)", ["D-1000 MK II", "D-1000 MK II (黒)", "《特価》 D-1000 MK II (黒)"]),
    ("x", "C-2800+AD-290V", ["C-2800", "C-2800+AD-290V"]), ("x", "D1 [ABC-1234]", ["D1", "D1 [ABC-1234]"]), ("x", "D1【売約済】", ["D1", "D1【売約済】"]), ("x", "D1 Pro / White (pair)", ["D1 PRO", "D1 PRO/WHITE (PAIR)"]),
    ("x", "+1", ["+1"]), ("x", "  ", []), ("x", None, []), (None, "D1", ["D1"]),
])
def test_variants(spark, maker, model, names):
    row = spark.createDataFrame([(maker, model)], "m string, d string")
    assert cm.with_variants(row, "m", "d", "names").first().names == names


def test_listings_models_are_normalised_once(spark, tables):
    """Python sees each distinct model once, neither again for the own name nor for each of its names."""
    plan = cm.matches(spark.createDataFrame([(1, "Denon", "pma - 1", "resolved")], LISTING), *tables)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[nfkc\((?:coalesce\()?model#", plan)) == 1


def test_products_are_never_broadcast_for_their_categories(spark, tables, tmp_path):
    """Which products take part is joined by sorting, however few they seem from the bytes of a file; small tables are broadcast by default."""
    listings = spark.createDataFrame([(1, "Denon", "pma - 1", "resolved")], LISTING)
    sources = spark.createDataFrame([(1, "manual_verified", "active")], "product_id long, source_type string, status string")
    for i, t in enumerate((*tables, sources)):
        t.write.parquet(f"{tmp_path}/{i}")
    *tables, sources = (spark.read.parquet(f"{tmp_path}/{i}") for i in range(4))
    for out in (cm.matches(listings, *tables), cm.manual_matches(listings, *tables, sources)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin .*LeftSemi", plan) and re.search(r"SortMergeJoin .*LeftSemi", plan)


@pytest.fixture(scope="module")
def tables(spark):
    products = spark.createDataFrame([
        (1, "denon", "PMA-1", "PMA-1", "verified"), (2, "denon", "PMA-2-SP", "PMA-2-SP", "verified"), (3, "denon", "PMA-2", "PMA-2", "verified"), (4, "denon", "PMA-4", "PMA-4", "pending"),
        (5, "denon", "PMA-5", "PMA-5", "verified"), (6, "denon", "PMA-6", "PMA-6", "verified"), (7, "other", "PMA-1", "PMA-1", "verified"),
    ], PRODUCT)
    aliases = spark.createDataFrame([(1, "One"), (5, "same"), (6, "Same"), (3, "pma-3"), (4, "four")], "product_id long, alias string")
    categories = spark.createDataFrame([(i, c, p) for i in (1, 2, 3, 4, 6, 7) for c, p in (("dac", False), ("amp", True), ("amp", True))] + [(5, "dac", False)], "product_id long, category_id string, is_primary boolean")
    return products, aliases, categories


def test_ranks_and_void_names(spark, tables):
    """PMA-2 is the name of one product and derived from another; `same` is an alias of two; a product without a primary category takes no part."""
    rows = [(1, "Denon", "pma - 1", "resolved"), (2, "denon", "PMA-1-SP", ""), (3, "denon", "one", None), (4, "denon", "PMA-2", "resolved"), (5, "denon", "PMA-2-SP", "resolved"), (6, "denon", "same", "resolved"),
            (7, "denon", "PMA-1", "candidate"), (8, "denon", "PMA-4", "resolved"), (9, None, "PMA-1", "resolved"), (10, "denon", None, "resolved"), (11, "denon", "PMA-3 / 黒", "resolved"), (12, "other", "PMA-1", "resolved")]
    got = {r.listing_id: (r.product_id, r.match_type, r.matched_name) for r in cm.matches(spark.createDataFrame(rows, LISTING), *tables).collect()}
    assert got == {
        1: (1, "exact", "PMA-1"), 2: (1, "derived_alias", "PMA-1"), 3: (1, "alias", "ONE"), 5: (2, "exact", "PMA-2-SP"), 6: (6, "alias", "SAME"), 11: (3, "derived_alias", "PMA-3"), 12: (7, "exact", "PMA-1"),
    }
    both = tables[2].unionByName(spark.createDataFrame([(5, "amp", True)], tables[2].schema))
    assert 6 not in {r.listing_id for r in cm.matches(spark.createDataFrame(rows, LISTING), *tables[:2], both).collect()}


def test_by_hand_only_for_unresolved_models(spark, tables):
    rows = [(1, "denon", "PMA-1", "candidate"), (2, "denon", "PMA-1-SP", "candidate"), (3, "denon", "one", "unresolved"), (4, "denon", "PMA-1", "resolved"), (5, "denon", "PMA-1", ""), (6, "denon", "PMA-6", "candidate"), (7, "denon", "PMA-2", "candidate")]
    sources = spark.createDataFrame([(1, "manual_verified", "active"), (3, "manual_verified", "active"), (6, "manual_verified", "gone"), (6, "official", "active")], "product_id long, source_type string, status string")
    got = cm.manual_matches(spark.createDataFrame(rows, LISTING), *tables, sources).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "exact", "amp"), (3, 1, "alias", "amp"), (7, 3, "exact", "amp")]


def test_candidates_feed_identity(spark, tables):
    found = cm.identity_candidates(*tables[:2])
    assert {r.product_id: r.aliases for r in found.collect()} == {1: ["One"], 2: ["PMA-2"], 3: ["pma-3"], 5: ["same"], 6: ["Same"], 7: []}
    rows = spark.createDataFrame([(1, "denon", "ONE", "resolved"), (2, "denon", "PMA-2", "resolved"), (3, "denon", "same", "resolved")], LISTING)
    got = {r.listing_id: (r.method, r.catalog_product_id) for r in resolution.resolve(rows, found).collect()}
    assert got == {1: ("manufacturer_alias", 1), 2: ("manufacturer_model_exact", 3), 3: ("alias_ambiguous", None)}
