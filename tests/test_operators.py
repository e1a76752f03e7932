from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ingest, quality, queue, resolution, search
from tidemark.plans import QUERIES
from tidemark.sources import csv_sink, html


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_identity_model(spark):
    for v in ("D1000MKII", "D1000 MK2", "D-1000 MKII", "D 1000 MK II"):
        assert one(spark, text.identity_model, v) == "D1000MK2"


def test_prices_and_text(spark):
    assert one(spark, text.parse_yen, "価格 ￥１２,０００") == 12000
    assert one(spark, text.parse_yen, "98,000円(税込)") == 98000
    assert one(spark, text.parse_yen, "ask") is None
    assert one(spark, text.clean_text, "<b>A&amp;B</b>　 c") == "A&B c"
    assert one(spark, text.safe_url, "javascript:x") == ""
    assert one(spark, text.nfkc, "ＡＢ①") == "AB1"


def test_identity_model_computes_its_text_once(spark):
    """However often patterns and conditions name it, in a filter too."""
    df = spark.createDataFrame([("D-1000 MK II",)], "m string").select(text.identity_model(F.substring("m", 1, 99)).alias("k")).where("k <> ''")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert max(x.count("substring(") for x in lines) == 1 and df.first().k == "D1000MK2"


def test_resolve(spark):
    catalog = spark.createDataFrame([(101, "tad", "D1000MK2", ["D-1000 MKII"]), (102, "kef", "LS50", [])], "product_id long, manufacturer_id string, canonical_model string, aliases array<string>")
    rows = [(1, "tad", "D 1000 MK II", "resolved"), (2, "tad", "D1000", "resolved"), (3, "kef", "LS50 Meta", "resolved"), (4, "kef", "", "resolved"), (5, "tad", "D1000MK2", "unresolved"), (6, None, None, None)]
    out = {r.listing_id: r for r in resolution.resolve(spark.createDataFrame(rows, "listing_id long, manufacturer_id string, model string, model_status string"), catalog).collect()}
    assert (out[1].status, out[1].method, out[1].catalog_product_id) == ("matched", "manufacturer_model_exact", 101)
    assert out[2].method == "vetoed" and out[3].method == "vetoed"
    assert out[4].method == "missing_fields" and out[5].method == "unresolved_model" and out[6].method == "missing_fields"


def test_cursor_pages_every_entity_once(spark):
    e = spark.createDataFrame([(i, None if i % 5 == 0 else i // 3) for i in range(40)], "entity_id long, lowest_price_yen long")
    for sort in ("priceAsc", "priceDesc"):
        seen, cursor = [], None
        while True:
            rows = search.page(e, sort, 7, cursor=cursor).collect()
            seen += [r.entity_id for r in rows[:7]]
            if len(rows) <= 7:
                break
            cursor = search.encode_cursor(sort, rows[6].lowest_price_yen, rows[6].entity_id)
        assert sorted(seen) == list(range(40))
    assert search.decode_cursor("nonsense", "priceAsc") is None


def test_fold(spark):
    state = "shop_key string, source_id string, title string, price_yen long, stock_status string, previous_price_yen long, first_seen_at timestamp, last_seen_at timestamp, is_active boolean"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("s", x, "t", 10, "in_stock", None, t, t, True) for x in "abc"], state)
    b = spark.createDataFrame([("s", "a", "t", 12, "in_stock"), ("s", "b", "t", 10, "in_stock"), ("s", "d", "t", None, "unknown"), ("s", "d", "t", 5, "in_stock")], "shop_key string, source_id string, title string, price_yen long, stock_status string")
    out = {r.source_id: r for r in ingest.fold(s, b, "2024-01-02 00:00:00", True).collect()}
    assert [out[x].action for x in "abcd"] == ["update", "touch", "deactivate", "insert"]
    assert out["a"].previous_price_yen == 10 and out["d"].price_yen == 5 and not out["c"].is_active
    assert all(r.action != "deactivate" for r in ingest.fold(s, b.limit(0), "2024-01-02 00:00:00", False).collect())


def test_quality_and_queue(spark):
    r = spark.range(1).select(quality.rate(F.lit(0), F.lit(0)).alias("r"), quality.worst(F.lit("unknown"), F.lit("warning")).alias("w"), queue.backoff_minutes(F.lit(9)).alias("b")).first()
    assert (r.r, r.w, r.b) == (None, "warning", 960.0)


def test_csv_and_html(spark, tmp_path):
    df = spark.createDataFrame([(1, '=1+"x"'), (2, None)], "id long, name string")
    got = [r.line for r in csv_sink.lines(df, ["id"]).orderBy("id").collect()]
    assert got == ['"1","\'=1+""x""",""', '"2","",""']
    csv_sink.write(df, str(tmp_path / "out"), ["id"])
    assert sum(len(p.read_bytes()) for p in (tmp_path / "out").glob("part*")) > 0
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"A &amp; B","sku":"1","offers":{"price":"1,200","availability":"http://schema.org/InStock"}}]}</script>'
    rows = html.products(spark.createDataFrame([("u", page), ("v", '<a href="/x">Amp</a> ¥3,000 SOLD OUT'), ("w", None)], "url string, html string")).collect()
    assert {(r.title, r.price_yen, r.stock_status) for r in rows} == {("A & B", 1200, "in_stock"), ("Amp", 3000, "sold_out")}


def test_links_stay_on_their_host(spark):
    page = '<a href="/a">A</a><a href="/a">A longer</a><a href="//h.test/b">B</a><a href="https://h.test.evil/c">C</a><a href="//other.test/d">D</a>'
    rows = html.links(spark.createDataFrame([("https://h.test/list?x=1", page), ("https://h.test/n", None), ("no address", page)], "url string, html string")).collect()
    assert {(r.url, r.link, r.text) for r in rows} == {("https://h.test/list?x=1", "https://h.test/a", "A longer"), ("https://h.test/list?x=1", "https://h.test/b", "B")}


def test_best_rows(spark):
    rows = [("u", 0, "1", "", None, "unknown"), ("u", 1, "1", "Amp", 5, "in_stock"), ("v", 0, "1", "Amp", 5, "in_stock"), ("u", 2, "2", "", 7, "unknown")]
    out = html.best_rows(spark.createDataFrame(rows, html.SCHEMA)).collect()
    assert {(r.source_id, r.url, r.position) for r in out} == {("1", "u", 1), ("2", "u", 2)}


def test_stock_and_short_texts(spark):
    rows = [(True, False), (False, True), (True, True), (False, False)]
    got = spark.createDataFrame(rows, "s boolean, i boolean").select("s", "i", text.availability(F.col("s"), F.col("i")).alias("x")).collect()
    assert {(r.s, r.i): r.x for r in got} == {(True, False): "sold_out", (False, True): "in_stock", (True, True): "unknown", (False, False): "unknown"}
    assert one(spark, lambda c: text.truncated(c, 4), "abcdef") == "abc…"
    assert one(spark, lambda c: text.truncated(c, 4), "abcd") == "abcd"
    assert one(spark, lambda c: text.truncated(c, 4), None) is None
    assert one(spark, text.safe_url, "https://a.test/x") == "https://a.test/x" and one(spark, text.safe_url, None) == ""
    assert (one(spark, text.model_stem, "D1000MK2"), one(spark, text.model_variant, "D1000MK2")) == ("D1000", "MK2")
    assert (one(spark, text.model_stem, "LS50"), one(spark, text.model_variant, "LS50")) == ("LS50", "")


def test_settle_and_retain(spark):
    work = "id long, status string, attempt_count int, max_attempts int, available_at timestamp, lease_expires_at timestamp, ok boolean"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "processing", 0, 3, t, t, True), (2, "processing", 0, 3, t, t, False), (3, "processing", 2, 3, t, t, False)]
    q = spark.createDataFrame(rows, work)
    out = {r.id: r for r in queue.settle(q, F.col("ok"), "2024-01-02 00:00:00").collect()}
    assert [out[i].status for i in (1, 2, 3)] == ["resolved", "pending", "failed"]
    assert all(out[i].lease_expires_at is None for i in (1, 2, 3))
    wait = queue.settle(q, F.col("ok"), "2024-01-02 00:00:00").where("id = 2").select((F.unix_timestamp("available_at") - F.unix_timestamp(F.lit("2024-01-02 00:00:00"))).alias("x"))
    assert wait.first().x == 900
    kept = spark.createDataFrame([(i, t + dt.timedelta(days=i % 3)) for i in range(6)], "id long, at timestamp")
    assert [r.id for r in queue.retain(kept, "at", "2024-01-02 12:00:00", 3, "id").collect()][:2] == [0, 3]
    assert queue.retain(kept, "at", "2024-01-02 12:00:00", 10, "id").count() == queue.retain(kept, "at", "2024-01-02 12:00:00", 4, "id").count()


def test_similar_asks_for_all_and_meets_few(spark, sf):
    names = [f"Customer#{i:09d}" for i in range(130)] + ["Customer#00000001", "Custmer#000000001", "Xustomer#000000001", "Cüstomer#000000001", "short"]
    t = spark.createDataFrame([(1, x) for x in names], "g int, n string")
    a, b = (t.select("g", F.col("n").alias(x)) for x in "ab")

    def near(x, y):
        x, y = sorted((x, y), key=len)
        i = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
        return x != y and len(x) >= 8 and (x[i:] == y[i + 1 :] or (len(x) == len(y) and x[i + 1 :] == y[i + 1 :]))

    got = {(r.a, r.b) for r in resolution.similar(a, b, "g", "a", "b").collect()}
    assert got == {(x, y) for x in names for y in names if near(x, y)}
    assert any(not r.b.endswith("0") for r in QUERIES["similar_customers"](spark, sf).collect())


def test_similar_broadcasts_nothing_that_was_exploded(spark):
    rows = [("g", "prelude-1", i) for i in range(4)] + [("g", "prelude-2", 9), ("h", "prelude-3", 5), (None, "prelude-1", 6)]
    a = spark.createDataFrame(rows, "g string, a string, x int")
    b = a.select("g", F.col("a").alias("b"), F.col("x").alias("y"))
    out = resolution.similar(a, b, "g", "a", "b")
    assert sorted((r.a, r.x, r.b, r.y) for r in out.collect()) == [("prelude-1", i, "prelude-2", 9) for i in range(4)] + [("prelude-2", 9, "prelude-1", i) for i in range(4)]
    plan = resolution.similar(a.drop("x"), b.drop("y"), "g", "a", "b")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_whole_tables_are_asked(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert events.where("ts >= '2024-02-01'").count() == 0  # the fold's batch reaches to the end
    folded = QUERIES["crawl_fold"](spark, sf).agg(F.sum("n").alias("n")).first().n
    assert folded == events.select("user_id", "event_type").distinct().count()


def test_request_parameters():
    from tidemark.operators import reads

    allowed, numeric = {"q": 5, "limit": 4, "offset": 9}, {"limit", "offset"}
    assert reads.request([("q", "amp"), ("limit", "500"), ("offset", "99999")], allowed, numeric) == ({"q": "amp", "limit": 100, "offset": 10_000}, None)
    assert reads.request([], allowed, numeric) == ({"limit": 50, "offset": 0}, None)
    for parameters, code in (([("x", "1")], "unknown_parameter"), ([("q", "a"), ("q", "b")], "repeated_parameter"), ([("q", "abcdef")], "parameter_too_long"), ([("limit", "-1")], "not_a_number"), ([("limit", "²")], "not_a_number")):
        assert reads.request(parameters, allowed, numeric) == ({}, code)


def test_tree_of_any_depth_loses_no_node(spark):
    from tidemark.operators import reads

    rows = [(0, None, 5)] + [(i, i - 1, i) for i in range(1, 12)] + [(20, 99, 1), (30, 31, 1), (31, 30, 2), (40, None, 1), (41, 40, 7)]
    got = {r.id: (r.level, r.path) for r in reads.with_ancestors_order(spark.createDataFrame(rows, "id long, parent long, sort long"), "id", "parent", "sort").collect()}
    assert len(got) == len(rows) and got[11] == (12, [5, *range(1, 12)]) and got[41] == (2, [1, 7])
    assert got[20] == got[30] == got[31] == (None, None)
