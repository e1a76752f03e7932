import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.sources.shared import exists, new_folder

VERSIONS = {"manufacturer": 2, "model": 2, "category": 2, "identity": 2}
SCHEMA = "listing_id long, is_active boolean, a string, b long, manufacturer_version int, model_version int, category_version int, identity_version int, projection_required boolean"
QUEUE = "listing_id long, work_type string, work_key string, status string, attempt_count int"


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame([(i, i % 9 > 0, f"a{i % 3}", i, 1 + i % 2, 2, 2 if i % 5 else None, 2, i % 7 == 0) for i in range(40)], SCHEMA)


def test_restart_does_each_part_once(spark, listings):
    """A run that breaks off in its second part, and is started again over listings that have moved on, ends as one that didn't."""
    calls = []

    def resolve(rows):
        calls.append(len(calls))
        if len(calls) == 2:
            raise ValueError("lost")
        return rows.withColumn("a", F.upper("a")).withColumn("b", F.when(F.col("b") % 2 == 0, -F.col("b")).otherwise(F.col("b")))

    affected = listings.where("listing_id < 30").select("listing_id")
    path = new_folder(spark, "run")
    with pytest.raises(ValueError):
        replay.replay(listings, affected, resolve, path, "2026-01-01", ["a", "b"], 4)
    assert exists(spark, f"{path}/done/part=0/_SUCCESS") and not exists(spark, f"{path}/done/part=1/_SUCCESS")
    # a restart takes the affected rows of the run that broke off, not those it is given
    after, events = replay.replay(listings, listings.select("listing_id"), resolve, path, "2026-01-01", ["a", "b"], 4)
    assert len(calls) == 2 + 3
    rows = {r.listing_id: r for r in after.collect()}
    assert len(rows) == after.count() == 40
    assert all((r.a, r.b) == ((f"A{i % 3}", -i if i % 2 == 0 else i) if i < 30 else (f"a{i % 3}", i)) for i, r in rows.items())
    want = {(i, "a", f"a{i % 3}", f"A{i % 3}") for i in range(30)} | {(i, "b", str(i), str(-i)) for i in range(2, 30, 2)}
    told = events.collect()
    assert {(e.listing_id, e.field, e.previous_value, e.new_value) for e in told} == want and len(told) == len({e.event_key for e in told}) == len(want)
    again, same = replay.replay(listings, affected, resolve, path, "2026-01-01", ["a", "b"], 4)
    assert len(calls) == 5 and sorted(e.event_key for e in same.collect()) == sorted(e.event_key for e in told) and sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))


def test_nothing_affected(spark, listings):
    after, events = replay.replay(listings, listings.limit(0).select("listing_id"), lambda rows: rows, new_folder(spark, "run"), "2026-01-01", ["a"], 2)
    assert events.count() == 0 and sorted(map(tuple, after.collect())) == sorted(map(tuple, listings.collect()))


def test_affected_by_aliases(spark):
    rows = spark.createDataFrame(
        [(1, True, "ＴＡＤ 株式会社", ""), (2, True, "", "Tad D-1000"), (3, True, "", "Not TAD"), (4, False, "TAD", ""), (5, True, "Luxman", "TAD D"), (6, True, None, None), (7, True, " tad ", "x"), (8, True, "ティーエーディー", "")],
        "listing_id long, is_active boolean, raw_manufacturer string, title string",
    )
    aliases = spark.createDataFrame([("TAD",), ("ティーエーディー",), (None,), ("",)], "alias string")
    assert {r.listing_id for r in replay.affected_by_aliases(rows, aliases).collect()} == {1, 2, 7, 8}


def test_affected_by_products(spark):
    rows = spark.createDataFrame([(1, True, 5, "x", "y"), (2, True, None, "tad", "D1"), (3, False, 5, "tad", "D1"), (4, True, 6, "tad", "D2")], "listing_id long, is_active boolean, catalog_product_id long, manufacturer_id string, normalized_model string")
    products = spark.createDataFrame([(5, "tad", "D1")], "catalog_product_id long, manufacturer_id string, normalized_model string")
    assert {r.listing_id for r in replay.affected_by_products(rows, products).collect()} == {1, 2}


def test_sweeps_until_nothing_is_stale(spark, listings):
    """Each tick takes a page; a listing behind on two stages is repaired for the first, then for the next; what never succeeds fails at its third attempt."""
    set_ = lambda **c: lambda rows: rows.withColumns({k: F.lit(v) for k, v in c.items()})
    stuck = F.when(F.col("listing_id") == 7, F.lit(True)).otherwise(F.lit(False))
    steps = {"resolve_manufacturer": set_(manufacturer_version=2), "classify_category": set_(category_version=2), "rebuild_search_entity": lambda rows: rows.withColumn("projection_required", stuck)}
    queue = spark.createDataFrame([], QUEUE)
    first = replay.stale_work(listings, queue, VERSIONS, 5).collect()
    assert [(r.listing_id, r.work_type) for r in first] == [(2, "resolve_manufacturer"), (4, "resolve_manufacturer"), (6, "resolve_manufacturer"), (8, "resolve_manufacturer"), (10, "resolve_manufacturer")]
    at, ticks = listings, 0
    while True:
        at, queue = replay.sweep(at, queue, steps, VERSIONS, new_folder(spark, "sweep"), "2026-01-01", 12, ["a"], 1)
        ticks += 1
        s = replay.status(at, queue, VERSIONS).first()
        assert s.active_listings == 35 and ticks < 12
        if s.pending == 0 and replay.stale_work(at, queue, VERSIONS, 5).count() == 0:
            break
    assert s.stale_signals == s.stale_projection == 1 and s.failed == 1 and s.blocked and not s.complete and s.progress_percent == round(34 / 35 * 100, 2)
    assert [tuple(r) for r in queue.where("status = 'failed'").select("listing_id", "work_type", "attempt_count").collect()] == [(7, "rebuild_search_entity", 3)]
    assert queue.count() == queue.select("work_key").distinct().count()
    idle = at.where("NOT is_active").select("listing_id", "manufacturer_version").collect()
    assert {(r.listing_id, r.manufacturer_version) for r in idle} == {(i, 1 + i % 2) for i in range(0, 40, 9)}
