"""Categories from titles, shops' labels and hints on the driver's tables, each query with its DuckDB SQL.

Titles and labels are dealt to the rows of part and lineitem; what each of them means stands beside it, for the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.category_rules import category_named
from tidemark.operators import categories

#: Titles, and the category that the first rule to match gives.
TITLES = (
    ("オーディオUSBケーブル 1m", "cable_usb"), ("LAN Silent cable", "cable_lan"), ("PHONO DIN interconnect", "cable_phono"), ("AC power cord 2m", "cable_power"), ("HDMIケーブル", "cable_digital"),
    ("XLR インターコネクト", "cable_xlr"), ("RCA pair interconnect", "cable_rca"), ("スピーカーケーブル 3m", "cable_other"), ("Power Conditioner", "clean_power"), ("電源タップ 6口", "power_strip"),
    ("ネットワークスイッチ", "network_switch"), ("光アイソレーター", "optical_isolator"), ("Router", "router"), ("ミュージックサーバー 4TB", "music_server"), ("Master Clock", "master_clock"),
    ("インシュレーター 4個", "other_accessory"), ("オーディオラック", "rack"), ("AVR-X2800", "av_amp"), ("FM/AM TUNER", "other"), ("プリメインアンプ", "integrated_amp"), ("Control Amplifier", "pre_amp"),
    ("真空管パワーアンプ", "power_amp"), ("Headphone-Amplifier", "headphone_amp"), ("真空管 12AX7", "vacuum_tube"), ("CD/SACDトランスポート", "transport"), ("Network Audio Player", "network_player"),
    ("SACD/CDプレーヤー", "cd_sacd_player"), ("MC昇圧トランス", "phono_step_up_transformer"), ("管球式フォノイコライザー", "phono_eq"), ("アナログプレーヤー", "turntable"), ("トーンアーム", "tonearm"),
    ("head shell", "headshell"), ("MCカートリッジ", "cartridge"), ("Digital Audio Player", "dap"), ("Cayin カイン N6iii", "dap"), ("Astell&Kern アステルアンドケルン KANN ULTRA", "dap"), ("KANN ULTRA", ""),
    ("Astell&Kern SP2000用 レザーケース", ""), ("ガラスフィルム HiBy R6 III", ""), ("FiiO 見本の長い説明がここに入るので型番とは離れています ほかのもの M23", ""), ("Active Studio Speaker", "active_speaker"),
    ("センター・スピーカー", "center_speaker"), ("ブックシェルフ型スピーカー", "speaker_bookshelf"), ("トールボーイ", "speaker_floorstanding"), ("Sub-Woofer", "subwoofer"), ("Sound Bar", "other"), ("2Wayスピーカー", ""),
    ("完全ワイヤレスイヤホン", "btw_earphone"), ("AirPods Pro", "btw_earphone"), ("AirPods Max", "btw_headphone"), ("WH-1000XM5", "btw_headphone"), ("IEM", "wired_earphone"), ("ヘッドホン", "wired_headphone"),
    ("DDJ-400", "dj_dtm"), ("D/A Converter", "dac"), ("ＤＡＣ　ｕｎｉｔ", "dac"), ("中古品", ""), ("", ""),
)
#: Labels of shops: what they mean, and whether a label of the tree says so (1) or only the rules (0).
LABELS = (("", "", 0), ("ＵＳＢ ケーブル", "cable_usb", 1), ("アクセサリー", "other_accessory", 0), ("ステレオパワーアンプ", "power_amp", 0), ("スピーカー", "", 0), ("cd_sacd_transport", "transport", 1), ("カートリッジ", "cartridge", 1))
#: Hints, what they mean.
HINTS = (("", ""), ("DAC", "dac"), ("その他", ""), ("見本のターンテーブル", "turntable"))
#: Titles that meet the labels.
SOLD = (("L-507Z プリメインアンプ", "integrated_amp"), ("AT-LH15H ヘッドシェル", "headshell"), ("X-1", ""), ("USB cable", "cable_usb"), (None, ""))


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(values, n):
    """One of the values by n, counted from 0."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def category_titles(spark, d):
    """Parts as listings: the category that each title names."""
    p = _t(spark, d, "part")
    title = F.concat_ws(" ", "p_brand", _dealt([t for t, _ in TITLES], F.col("p_partkey")))
    return p.select(F.col("p_partkey").alias("listing_id"), category_named(title).alias("category_id"))


def _values(rows):
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, (i, *r))) + ")" for i, r in enumerate(rows))


_TITLES = f"""SELECT p_partkey AS listing_id, c AS category_id FROM part JOIN (VALUES {_values(TITLES)}) AS t(i, title, c) ON i = p_partkey % {len(TITLES)}"""


def category_evidence(spark, d):
    """Line items as listings of shops with different policies: their evidence, and what it decides."""
    line = _t(spark, d, "lineitem")
    listings = line.select(
        F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))).alias("listing_id"),
        F.col("l_suppkey").cast("string").alias("shop_key"), _dealt([t for t, _ in SOLD], F.col("l_partkey")).alias("title"),
        _dealt([x for x, *_ in LABELS], F.col("l_linenumber") + F.col("l_partkey")).alias("raw_category"), _dealt([h for h, _ in HINTS], F.col("l_orderkey")).alias("hinted_category"),
    )
    shops = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("shop_key"), (F.col("s_suppkey") % 4).alias("k"))
    policies = shops.where("k > 0").select("shop_key", F.expr("element_at(array('corroborative', 'ignore', 'unknown word'), int(k))").alias("seller_default"), F.when(F.col("k") == 3, "ignore").when(F.col("k") == 2, "authoritative").alias("parser_hint"))
    overrides = shops.where("k = 1").select("shop_key", F.explode(F.array(F.lit("cable_usb"), F.lit("power_amp"))).alias("category_id"), F.lit("authoritative").alias("mode"))
    mappings = shops.where("k = 0").select("shop_key", F.lit(" アクセサリー ").alias("raw_category"), F.lit("rack").alias("category"), F.lit(0).alias("position"))
    out = categories.decide(categories.evidence(listings, policies, overrides, mappings))
    told = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x.source, x.category_id, x.strength)), " ")
    return out.select("listing_id", told.alias("evidence"), "category_id", "state", "source", F.array_join("candidates", ",").alias("candidates"))


_EVIDENCE = f"""WITH l AS (
    SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 9, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(l_linenumber AS VARCHAR), 9, '0')) AS listing_id,
      l_suppkey % 4 AS k, t.c AS tc, r.raw, CASE WHEN r.raw = 'アクセサリー' AND l_suppkey % 4 = 0 THEN 'rack' ELSE r.c END AS rc, r.sure + CAST(r.raw = 'アクセサリー' AND l_suppkey % 4 = 0 AS INTEGER) AS sure, h.hint, h.c AS hc
    FROM lineitem JOIN (VALUES {_values(SOLD)}) AS t(i, title, c) ON t.i = l_partkey % {len(SOLD)}
    JOIN (VALUES {_values(LABELS)}) AS r(i, raw, c, sure) ON r.i = (l_linenumber + l_partkey) % {len(LABELS)} JOIN (VALUES {_values(HINTS)}) AS h(i, hint, c) ON h.i = l_orderkey % {len(HINTS)}
  ), m AS (
    SELECT *, CASE WHEN rc = '' THEN '' WHEN k = 1 AND rc IN ('cable_usb', 'power_amp') THEN 'authoritative' WHEN sure = 0 OR rc IN ('other_accessory', 'cartridge') THEN 'supporting'
        WHEN k = 1 THEN 'supporting' WHEN k = 2 THEN '' ELSE 'authoritative' END AS rs,
      CASE WHEN raw <> '' OR hc = '' OR k = 3 THEN '' WHEN k = 2 THEN 'authoritative' ELSE 'supporting' END AS hs FROM l
  ), e AS (
    SELECT *, concat_ws(' ', CASE WHEN rs <> '' THEN 'seller_category:' || rc || ':' || rs END, CASE WHEN tc <> '' THEN 'title:' || tc || ':strong' END, CASE WHEN hs <> '' THEN 'parser_hint:' || hc || ':' || hs END) AS evidence,
      CASE WHEN rs = 'authoritative' THEN rc WHEN hs = 'authoritative' THEN hc WHEN tc <> '' THEN tc WHEN rs = 'supporting' AND raw IN ('アクセサリー', 'カートリッジ') THEN rc END AS c,
      CASE WHEN rs = 'authoritative' THEN 'seller_category' WHEN hs = 'authoritative' THEN 'parser_hint' WHEN tc <> '' THEN 'title' ELSE 'seller_category' END AS s FROM m
  )
  SELECT listing_id, evidence, coalesce(c, 'unclassified') AS category_id, CASE WHEN c IS NULL THEN 'unclassified' ELSE 'classified' END AS state, CASE WHEN c IS NULL THEN 'unclassified' ELSE s END AS source,
    CASE WHEN c IS NULL THEN concat_ws(',', CASE WHEN rs <> '' THEN rc END, CASE WHEN hs <> '' THEN hc END) ELSE '' END AS candidates FROM e"""


def category_shelves(spark, d):
    """Parts as listings that nothing has classified: the label to show, from a hint or the title."""
    p = _t(spark, d, "part")
    hint = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("棚"), F.col("p_size").cast("string"))).when(F.col("p_size") % 10 == 1, "")
    return p.select(F.col("p_partkey").alias("listing_id"), categories.shelf(F.concat_ws(" ", "p_name", _dealt([t for t, _ in TITLES], F.col("p_partkey"))), hint).alias("shelf"))


#: The shelf of each of TITLES.
SHELF_OF = (
    "ケーブル・アクセサリー", "ケーブル・アクセサリー", "アナログ", "その他", "ケーブル・アクセサリー", "その他", "その他", "スピーカー", "その他", "ケーブル・アクセサリー", "ネットワーク", "その他", "その他", "その他", "その他",
    "ケーブル・アクセサリー", "その他", "その他", "その他", "プリメインアンプ", "プリアンプ", "パワーアンプ", "ヘッドホン", "その他", "CD/SACDプレーヤー", "ネットワーク", "CD/SACDプレーヤー", "その他", "その他", "その他", "その他", "その他",
    "アナログ", "DAP・ヘッドホンアンプ", "その他", "その他", "その他", "その他", "その他", "その他", "スピーカー", "スピーカー", "スピーカー", "その他", "その他", "その他", "スピーカー", "イヤホン", "その他", "その他", "その他", "イヤホン",
    "ヘッドホン", "DJ機器・DTM", "DAC", "その他", "その他", "その他",
)
_SHELVES = f"""SELECT p_partkey AS listing_id, CASE WHEN p_size % 10 = 0 THEN '棚' || p_size ELSE s END AS shelf
  FROM part JOIN (VALUES {_values([(s,) for s in SHELF_OF])}) AS t(i, s) ON i = p_partkey % {len(SHELF_OF)}"""

QUERIES = {f.__name__: f for f in (category_titles, category_evidence, category_shelves)}
ORACLES = {"category_titles": _TITLES, "category_evidence": _EVIDENCE, "category_shelves": _SHELVES}
