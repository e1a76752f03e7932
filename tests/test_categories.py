import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.category_rules import RULES, Rules
from tidemark.functions.text import nfkc
from tidemark.operators import categories, classification
from tidemark.plans.categories import TITLES

READ = Rules()


@pytest.mark.parametrize("i", [i for i, (_, p) in enumerate(RULES) if p])
def test_no_match_without_an_anchor(i):
    pattern = re.compile(RULES[i][1], re.I | re.A)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(pattern))
    def check(text):
        text = unicodedata.normalize("NFKC", text)
        if pattern.search(text):
            assert i in READ.near(text)

    check()


def test_first_rule_decides():
    for title, category in TITLES:
        assert READ(title) == category, title
        # held against every rule in order, without the automaton
        text = unicodedata.normalize("NFKC", title)
        plain = (c for c, p in READ.rules if (READ.player(text) if p is None else p.search(text)))
        assert next(plain, "") == category
    assert {c for c, _ in RULES} == {c for _, c in TITLES if c}


def test_players_need_their_brand_close_by():
    brands = ("HiBy ハイビー R5Gen2", "FiiO フィーオ M23 [FIO-M23]", "LUXURY&PRECISION E7", "Shanling シャンリン M6 Ultra", "iBasso DX320", "アステル SP3000", "cayin n7")
    assert all(READ(t) == "dap" for t in brands)
    others = ("M23", "R6 III", "FiiO K11", "Cayin C9", "FiiO" + " " * 40 + "M23", "ケース Astell&Kern SP2000", "iBasso DX320 leather case", "M23 FiiO")
    assert all(READ(t) == "" for t in others)
    assert READ("iBasso DX320 showcase") == "dap" and READ("FiiO M23 イヤホン") == "dap" and READ("FiiO M23 交換ケーブル") == "cable_other"


def test_white_space_and_lines():
    assert READ("power　conditioner") == READ("ｐｏｗｅｒ\tconditioner") == "clean_power"
    assert READ("usb a\r\nmini cable") == "cable_other" and READ("usb a mini cable") == "cable_usb"
    assert READ(None) == READ("  ") == ""


def test_tree():
    rows = categories.rows()
    assert [i for i, g, *_ in rows if g is None] == ["amplifier", "digital", "analog", "speaker", "headphone_group", "accessories", "dj_dtm", "other", "unclassified"]
    assert categories.closure("headshell") == ["headshell", "cartridge", "analog"] and categories.closure("speaker") == categories.closure("unclassified") == []
    assert set(categories.filter_ids("cable")) == {"cable", *(i for i, g, *_ in rows if g == "cable")}
    assert "network_transport" in categories.filter_ids("digital") and categories.filter_ids("unclassified") == [] == categories.filter_ids("?")
    assert categories.filter_ids("レコード・プレイヤー") == ["turntable"] and categories.filter_ids("speaker_other")[0] == "speaker"
    assert {c for c, _ in RULES} <= {i for i, *_ in rows} - {*categories.GROUPS, "unclassified"}


def test_labels(spark):
    want = {
        "ＵＳＢ　ケーブル": "cable_usb", "Integrated Amplifier": "integrated_amp", "accessory": "other_accessory", "speaker": None, "cable": "cable_other", "cables": None, "ケーブル": None,
        "D-A Converter": "dac", "Centre Channel Speakers": "center_speaker", "フォノイコライザ": "phono_eq", "unclassified": None, "": None, None: None, "headphone": "wired_headphone", "Headphone": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "label string")
    assert {r.label: r.a for r in rows.select("label", categories.answer("label").alias("a")).collect()} == want


def test_evidence_is_decided_as_by_rows(spark):
    """Every combination of label, title, hint and policy: the row's own decision is the one over exploded evidence."""
    labels = ["", "アクセサリー", "カートリッジ", "USBケーブル", "ステレオパワーアンプ", "スピーカー", None]
    rows = [(n, f"s{p}", t, r, h) for n, (p, t, r, h) in enumerate((p, t, r, h) for p in range(4) for t in ("", "ヘッドシェル", "X") for r in labels for h in ("", "DAC", None))]
    listings = spark.createDataFrame(rows, "listing_id long, shop_key string, title string, raw_category string, hinted_category string")
    policies = spark.createDataFrame([("s1", "corroborative", None), ("s2", "ignore", "authoritative"), ("s3", "no such", "ignore")], "shop_key string, seller_default string, parser_hint string")
    overrides = spark.createDataFrame([("s1", "power_amp", "authoritative"), ("s1", "cartridge", "ignore")], "shop_key string, category_id string, mode string")
    mappings = spark.createDataFrame([("s3", "スピーカー", "nothing", 0), ("s3", " 中古 ", "dac", 1), ("s0", "スピーカー", "speaker_other", 0), ("s0", "ｽﾋﾟｰｶｰ", "dac", 1)], "shop_key string, raw_category string, category string, position int")
    told = categories.evidence(listings, policies, overrides, mappings)
    mine = {r.listing_id: (r.category_id, r.state, r.source, sorted(r.candidates)) for r in categories.decide(told).collect()}
    flat = told.select("listing_id", F.posexplode("evidence").alias("position", "e")).select("listing_id", "position", "e.*")
    theirs = {r.listing_id: (r.category_id, r.state, r.source, r.candidates) for r in classification.classify(flat, ["verified", "authoritative", "strong"]).collect()}
    assert {k: v for k, v in mine.items() if k in theirs} == theirs
    assert all(v == ("unclassified", "unclassified", "unclassified", []) for k, v in mine.items() if k not in theirs)
    by = {(r.shop_key, r.title, r.raw_category, r.hinted_category): [(e.source, e.category_id, e.strength) for e in r.evidence] for r in told.collect()}
    assert by["s0", "X", "アクセサリー", "DAC"] == [("seller_category", "other_accessory", "supporting")]
    assert by["s1", "X", "ステレオパワーアンプ", ""] == [("seller_category", "power_amp", "authoritative")] and by["s1", "X", "カートリッジ", ""] == []
    assert by["s0", "X", "スピーカー", ""] == [("seller_category", "other", "supporting")] and by["s3", "X", "スピーカー", ""] == []
    assert by["s2", "ヘッドシェル", None, "DAC"] == [("title", "headshell", "strong"), ("parser_hint", "dac", "authoritative")]


def test_nfkc_of_batches(spark):
    texts = ["カートリッジ", "ｶﾞ", "Ａ１", "plain", "", None, "㍿", "é"]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "t string").select("t", nfkc("t").alias("n")).collect()
    assert len(rows) == 24 and all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in rows)
