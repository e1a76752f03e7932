"""Manufacturers, models, categories, candidates, repair and robots on small fixtures."""

from pyspark.sql import functions as F

from tidemark.operators import catalog, classification, manufacturers, models, remediation
from tidemark.sources import robots


def test_manufacturers(spark):
    aliases = spark.createDataFrame(
        [("tad", "TAD", "TAD", "verified", "review"), ("silent", "Silent Angel", "Silent Angel", "verified", "code_bootstrap"), ("x1", "X", "Twin", "verified", "review"), ("x2", "X", "Twin", "verified", "review"), ("p", "P", "Pend", "pending", "review")],
        "manufacturer_id string, canonical_name string, alias string, verification_status string, source string",
    )
    rows = [
        (1, "ＴＡＤ Co., Ltd.", None, None), (2, None, None, "【中古】TAD D1000"), (3, "Silent", None, "Silent Angel Bonn"), (4, "Twin", None, None), (5, "Pend", "", ""), (6, "不明", None, "TAD D1000"),
        (7, None, None, None), (8, "Unknown", None, "TAD D1000"), (9, None, None, "TADX 1"), (10, None, None, "silent-angel N8"), (11, None, "tad", "x"),
    ]
    out = {r.listing_id: r for r in manufacturers.resolve(spark.createDataFrame(rows, "listing_id long, raw_manufacturer string, manufacturer_candidate string, title string"), aliases).collect()}
    assert len(out) == len(rows)
    assert (out[1].manufacturer_id, out[1].method) == ("tad", "verified_alias")
    assert (out[3].manufacturer_id, out[3].method) == ("silent", "title_bootstrap_alias")
    assert (out[4].status, out[4].method, out[4].candidate_ids) == ("candidate", "ambiguous_alias", ["x1", "x2"])
    assert (out[5].method, out[5].candidate_ids) == ("unverified_alias", ["p"])
    assert [out[i].status for i in (6, 7, 8, 9)] == ["unresolved"] * 4 and out[8].display_name == "Unknown"
    assert out[10].manufacturer_id == "silent" and out[11].manufacturer_id == "tad"


def test_models(spark):
    cases = {
        "D-1000 中古美品": "condition", "D-1000 USED": "condition", "D-1000 【売約済】": "listing_state", "D-1000 SOLD OUT": "listing_state", "D-1000 元箱付": "packaging", "D-1000 リモコン付": "packaging",
        "D-1000 [ABC-12345]": "seller_sku", "D-1000 管理番号:AB1234": "seller_sku", "D-1000 / シルバー": "presentation_color", "D-1000 (BK)": "presentation_color",
        "D-1000 サテン・ホワイト": "presentation_color", "D-1000 カラー: HIGH  GLOSS BLACK": "presentation_color", "D-1000(TITANIUM GREY) ペア": "presentation_color", "D-1000 未使用開封品": "condition",
        "D-1000 パワーアンプ": "product_type_suffix", "D-1000 CDデッキ アキュフェーズ": "seller_title_suffix", "D-1000 ※送料無料": "shipping", "D-1000 《店頭展示》": "seller_sku",
    }
    rows = [(i, "tad", x, None) for i, x in enumerate(cases)] + [(90, "tad", "TAD D-1000 MK2 中古美品", None), (91, "tad", None, "TAD D-1000"), (92, None, None, "TAD D-1000"), (93, "tad", "FS-700S3/B", None), (94, None, None, None), (95, "tad", "中古", None), (96, "tad", "D-1000 SATIN GOLD", None)]
    listings = spark.createDataFrame(rows, "listing_id long, manufacturer_id string, raw_model string, title string")
    out = {r.listing_id: r for r in models.resolve(listings, spark.createDataFrame([("tad", "TAD")], "manufacturer_id string, alias string")).collect()}
    for i, (text, note) in enumerate(cases.items()):
        assert (out[i].model, out[i].status, out[i].removed) == ("D-1000", "resolved", [note]), text
    assert (out[96].model, out[96].removed) == ("D-1000 SATIN", ["presentation_color"])  # no shade of gold: the finish alone goes
    assert (out[90].model, out[90].normalized_model) == ("D-1000 MK2", "D1000MK2")
    assert (out[91].method, out[92].status, out[93].model, out[94].status) == ("title_after_manufacturer", "unresolved", "FS-700S3/B", "unresolved")


def test_long_numbers_of_models(spark):
    rows = spark.createDataFrame([(1, "tad", "D-12345 USED", None), (2, "tad", "E-800 123456", None), (3, "tad", "12345", None), (4, "tad", "D-1 12345-67890", None), (5, "tad", None, "TAD D-123456")], "listing_id long, manufacturer_id string, raw_model string, title string")
    names = spark.createDataFrame([("tad", "TAD")], "manufacturer_id string, alias string")
    found = lambda **how: {r.listing_id: (r.model, r.status, r.residue) for r in models.resolve(rows, names, **how).collect()}
    doubt = lambda model: (model, "candidate", ["seller_number"])
    assert found() == {1: doubt("D-12345"), 2: doubt("E-800 123456"), 3: doubt("12345"), 4: doubt("D-1 12345-67890"), 5: doubt("D-123456")}
    assert found(joined_numbers=True) == found() | {1: ("D-12345", "resolved", []), 5: ("D-123456", "resolved", [])}


def test_model_query_with_long_numbers(spark, tmp_path, same):
    import duckdb

    from tidemark.plans import ORACLES, QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_partkey", F.col("p_partkey") * 997 + 9_950)
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sql = f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')"
    with duckdb.connect() as con:
        con.execute(sql)
        same(QUERIES["model_resolution"](spark, str(tmp_path)), con.execute(ORACLES["model_resolution"]).fetchdf())


def test_mentions(spark):
    df = spark.createDataFrame([("The D–1000 mk2 amp", "D-1000MK2"), ("D1000 MK2.", "D-1000 MK2"), ("XD1000", "D1000"), ("", "D1"), ("a D1", None)], "t string, m string")
    assert [r[0] for r in df.select(models.mentions(F.col("t"), F.col("m"))).collect()] == [False, True, False, False, False]
    assert [r[0] for r in df.select(models.mentions(F.col("t"), F.col("m"), False)).collect()] == [False, False, False, False, False]


def test_categories(spark):
    rows = [
        (1, 1, "amp", "a", "strong", ""), (1, 2, "amp", "b", "strong", ""), (1, 3, "dac", "c", "supporting", ""), (2, 1, "amp", "a", "verified", ""), (2, 2, "dac", "a", "verified", ""),
        (3, 1, "cartridge", "seller_category", "supporting", " Cartridge"), (4, 1, "amp", "seller_category", "supporting", "amp"), (5, 1, "cartridge", "seller_category", "supporting", "cartridge"), (5, 2, "amp", "t", "other", None), (6, 1, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, "listing_id long, position int, category_id string, source string, strength string, value string")
    out = {r.listing_id: (r.category_id, r.state, r.source) for r in classification.classify(e, ["verified", "authoritative", "strong"]).collect()}
    assert out == {1: ("amp", "classified", "a+b"), 2: ("unclassified", "ambiguous", "ambiguous"), 3: ("cartridge", "classified", "seller_category"), 4: ("unclassified", "unclassified", "unclassified"), 5: ("unclassified", "ambiguous", "ambiguous")}


def test_features(spark):
    rows = spark.createDataFrame([(1, "内蔵DAC プリ"), (2, "DACT x"), (3, "ＤＡＣ搭載 ヘッドホン端子 phono in"), (4, None)], "listing_id long, title string")
    facts = classification.feature_facts(rows)
    assert sorted((r.listing_id, r.feature) for r in facts.collect()) == [(1, "dac"), (3, "dac"), (3, "headphone_output"), (3, "phono_input")]
    stored = spark.createDataFrame([(1, "phono_input", "present", "title", 0.8), (1, "dac", "absent", "official", 1.0)], facts.schema)
    out = classification.sync_facts(stored, facts, rows)
    assert sorted((r.feature, r.source) for r in out.where("listing_id = 1").collect()) == [("dac", "official"), ("dac", "title")]


def test_candidates_keep_first_spellings(spark):
    rows = [(i, "s", "M", "K", "m", "k", f"v{99 - i}", None, "", ["other"], "classified", None, None, None, None) for i in range(15)] + [(99, "s", " ", "K", None, None, None, None, None, None, None, None, None, None, None)]
    c = spark.createDataFrame(rows, "listing_id long, shop_key string, manufacturer_id string, normalized_model string, manufacturer string, model string, raw_model string, title string, source_url string, category_ids array<string>, classification_status string, identity_status string, identity_method string, first_seen_at timestamp, last_seen_at timestamp")
    out = catalog.candidates(c).collect()
    assert len(out) == 1 and out[0].raw_model == sorted(f"v{99 - i}" for i in range(10)) and out[0].source_url == []
    assert (out[0].listings, out[0].other, out[0].unresolved, out[0].reason, out[0].priority) == (15, 15, 15, "missing_resolution", 15 * 80 + 15 * 40 + 10 + 9)


def test_due_and_reclassify(spark):
    p = spark.createDataFrame([(1, "verified", "ok", None), (2, "verified", "ok", "2024-01-30"), (3, "verified", "due", None), (4, "pending", "ok", None)], "catalog_product_id long, verification_status string, review_status string, at string")
    p = p.withColumns({"last_verified_at": F.col("at").cast("timestamp"), "category_id": F.lit("amp")})
    assert [r.catalog_product_id for r in catalog.due(p, "2024-02-01").collect()] == [1]
    lst = spark.createDataFrame([(1, "matched", 1, "dac"), (2, "matched", 1, "amp"), (3, "unresolved", 1, "dac"), (4, "matched", 2, None)], "listing_id long, identity_status string, catalog_product_id long, category_id string")
    assert sorted(r.listing_id for r in catalog.reclassify(lst, p).collect()) == [1, 4]


def test_identity_sync_writes_only_changes(spark):
    schema = "listing_id long, status string, method string, catalog_product_id long"
    old = spark.createDataFrame([(1, "matched", "exact", 5), (2, "unresolved", "none", None)], schema)
    new = spark.createDataFrame([(1, "matched", "exact", 6), (2, "unresolved", "none", None), (3, None, None, None)], schema)
    assert sorted(r.listing_id for r in remediation.identity_sync(old, new).collect()) == [1, 3]


def test_robots(spark):
    text = "Disallow: /\nUser-agent: a\nUser-agent: ExampleBot\nDisallow: /p # note\nAllow: /p/q\nDisallow: /p/q\nCrawl-delay: 3\nCrawl-delay: x\nUser-agent: *\nDisallow: /\nCrawl-delay: 9"
    pol = spark.createDataFrame([("h", text), ("e", ""), ("n", None), ("s", "User-agent: *\nDisallow: /*.php$\nDisallow:")], "host string, text string")
    urls = ["http://h/p", "https://h/p/q?x#y", "http://h/z", "http://e/p", "http://n/", "http://s/a.php", "http://s/a.php?b", "http://s?c", "http://other/", None, "odd"]
    out = {r.url: r.allowed for r in robots.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), pol, "ExampleBot/2").collect()}
    assert out == dict(zip(urls, [False, True, True, True, True, False, True, True, True, True, True]))
    assert {r.host: r.delay_ms for r in robots.crawl_delay_ms(pol, "ExampleBot").collect()} == {"h": 3000.0, "e": 0.0, "n": 0.0, "s": 0.0}
    assert {r.host: r.delay_ms for r in robots.crawl_delay_ms(pol, "Zed").collect()}["h"] == 9000.0


def test_coverage_and_candidate_stats(spark):
    df = spark.createDataFrame([(True, False, True, False), (True, False, False, True), (True, False, False, False), (True, True, True, True), (False, False, True, True), (None, False, True, True)], "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in df.select(robots.deactivates_missing(*(F.col(x) for x in "abcd"))).collect()] == [True, True, False, False, False, False]
    rows = spark.createDataFrame([(1, "pending"), (2, "matched"), (0, "pending"), (3, "ignored"), (1, "pending")], "listings long, review_status string")
    assert catalog.stats(rows).first().asDict() == {"candidates": 4, "pending": 2, "matched": 1, "ignored": 1}
    assert catalog.stats(rows.limit(0)).first().candidates == 0
