import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.text_index import TextIndex
from tidemark.sources.shared import new_folder

SCHEMA = "id long, a string, b string"


def brute(rows, query, weights):
    """bm25 over terms of three characters and more; every term in some column."""
    terms = search.plan_terms(query)
    texts = {i: [(x or "").lower() for x in cols] for i, *cols in rows}
    places = lambda x, t: sum(x.startswith(t, i) for i in range(len(x)))
    size = {i: sum(max(0, len(x) - 2) for x in t) for i, t in texts.items()}
    mean = max(sum(size.values()), 1) / len(texts)
    worth = {t: max(1e-6, math.log((len(texts) - n + 0.5) / (n + 0.5))) for t in terms for n in [sum(any(t in x for x in v) for v in texts.values())]}
    out = {}
    for i, v in texts.items():
        f = [sum(w * places(x, t) for x, w in zip(v, weights)) for t in terms]
        if terms and all(f):
            out[i] = round(sum(worth[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t, n in zip(terms, f) if len(t) > 2), 9)
    return out


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ti", "tin", "TAD", "tadtad", "aaaa", "プリ", "プリメイン", "x", "D-1000", "oO", ""])
    return [(i, " ".join(word() for _ in range(rng.randrange(5))), rng.choice([None, "", word(), word() * 3])) for i in range(n)]


QUERIES = ["ti", "t", "tad", "aaa", "aaaa aa", "プリ", "リメイン", "TIN ti x", "d-1000", '"tad" OR', "%", "n t", "", "tin tad tin", "tadtadtad"]


@pytest.fixture(scope="module")
def index(spark):
    rows = made(150, 1)
    return rows, TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(spark.createDataFrame(rows, SCHEMA))


def found(index, query, weights=(3.0, 1.0)):
    return {r.id: round(r.score, 9) for r in index.search(query, list(weights)).collect()}


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_brute_force(index, query):
    rows, ix = index
    assert found(ix, query) == pytest.approx(brute(rows, query, (3.0, 1.0)))


def test_reads_postings_of_the_terms_only(index, spark):
    plan = index[1].search("prelude D-1000")._jdf.queryExecution().toString()
    assert "/postings" in plan and "In(gram" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "LogicalRDD" not in plan and "Scan ExistingRDD" not in plan  # where the texts are


def test_tasks_hold_parts_of_fixed_size(index, spark, monkeypatch):
    """Places are dealt by id once, in parts by the index's rows, and not collected in a map before that; so are postings by their number."""
    from tidemark.operators import text_index

    rows, ix = index
    monkeypatch.setattr(text_index, "ROWS", 40)
    plan = ix.search("ti x")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" in plan and "hashpartitioning(id#" in plan and ", 4), REPARTITION_BY_NUM" in plan
    assert not re.search(r"Exchange hashpartitioning\(id#\w+, (?:col|term|p)", plan)
    assert found(ix, "ti x") == pytest.approx(brute(rows, "ti x", (3.0, 1.0)))
    monkeypatch.setattr(text_index, "PLACES", 300)
    small = TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(spark.createDataFrame(rows, SCHEMA))
    held = small.postings().groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] <= 600 < held[1] and found(small, "tad") == pytest.approx(brute(rows, "tad", (3.0, 1.0)))


def test_changes_by_key(spark):
    rows = {i: (i, a, b) for i, a, b in made(60, 2)}
    ix = TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(spark.createDataFrame(list(rows.values()), SCHEMA))
    for seed in (3, 4):
        new = {i + 30 * (seed - 3): (i + 30 * (seed - 3), a, b) for i, a, b in made(50, seed)}
        gone = [i for i in rows if i % 7 == seed % 7 and i not in new]
        ix.apply(spark.createDataFrame(list(new.values()), SCHEMA), spark.createDataFrame([(i,) for i in gone], "id long"))
        rows = {i: r for i, r in (rows | new).items() if i not in gone}
    live = spark.createDataFrame(list(rows.values()), SCHEMA)
    for q in ("tad", "ti", "tin tad", "プリ"):
        assert found(ix, q) == pytest.approx(brute(rows.values(), q, (3.0, 1.0)))
    assert ix.check(live).count() == 0
    # a generation that broke off before its totals were written is not there
    wrong = spark.createDataFrame([(1, "tad tad tad tad", "")], SCHEMA)
    before = found(ix, "tad")
    ix.apply(wrong)
    spark.read.parquet(f"{ix.path}/stats/gen=3").count()
    from tidemark.sources.shared import remove

    remove(spark, f"{ix.path}/stats/gen=3")
    assert found(ix, "tad") == before and ix.check(live).count() == 0
    ix.compact(live)
    assert [g for g, *_ in ix._stats()] == [3] and found(ix, "tad") == before and ix.check(live).count() == 0


def test_check_names_what_is_wrong(spark):
    rows = spark.createDataFrame([(1, "abcdef", None), (2, "", ""), (3, "xyz", "q"), (4, "same", "same")], SCHEMA)
    ix = TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(rows)
    assert ix.check(rows).count() == 0
    now = spark.createDataFrame([(1, "abcdeF", ""), (3, "xyz", "r"), (4, "same", "same"), (5, "new", None)], SCHEMA)
    assert {(r.id, r.problem) for r in ix.check(now).collect()} == {(2, "extra"), (3, "differs"), (5, "missing")}
    # one posting lost, one too many
    kept = spark.read.parquet(f"{ix.path}/postings/gen=0").where("NOT (id = 4 AND pos = 2 AND col = 1)")
    more = kept.where("id = 3 AND col = 1").withColumn("pos", F.lit(9))
    other = TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(rows)
    kept.unionByName(more).write.mode("overwrite").partitionBy("bucket").parquet(f"{other.path}/postings/gen=0")
    assert {(r.id, r.problem) for r in other.check(rows).collect()} == {(3, "differs"), (4, "differs")}


def test_empty_index(spark):
    ix = TextIndex(spark, new_folder(spark, "index"), "id", ("a", "b")).create(spark.createDataFrame([], SCHEMA))
    assert found(ix, "abc") == {} and ix.check(spark.createDataFrame([], SCHEMA)).count() == 0
    ix.apply(spark.createDataFrame([(1, "abc", None)], SCHEMA))
    assert found(ix, "abc").keys() == {1}


def test_product_filter(spark):
    e = spark.createDataFrame(
        [(1, "tad", "TAD", "headshell"), (2, "x", "【中古品】ラックス マン", "dac"), (3, "y", "ラックスマン", "other"), (4, "z", "Not ラックスマン", "dac"), (5, None, None, None)],
        "entity_id long, manufacturer_id string, manufacturer string, primary_category_id string",
    )
    ids = lambda f, *a: {r.entity_id for r in f.apply(e, *a).collect()}
    assert ids(search.ProductFilter(("tad",), ("ラックスマン",))) == {1, 2, 3} and ids(search.ProductFilter()) == {1, 2, 3, 4, 5}
    assert ids(search.ProductFilter(category="アナログ")) == {1} and ids(search.ProductFilter(category="no such")) == set()
    offers = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "entity_id long, listing_id long")
    facts = spark.createDataFrame([(10, "dac", "present"), (11, "phono_input", "present"), (20, "dac", "present"), (20, "phono_input", "absent")], "listing_id long, feature string, state string")
    assert ids(search.ProductFilter(features=("dac", "phono_input", "dac")), offers, facts) == {1}
    assert ids(search.ProductFilter(features=("dac",)), offers, facts) == {1, 2}
