"""The tree of categories, what labels of it mean, and a listing's category from its title, its shop's label and a hint.

All of it is decided in the listing's own row: shops' policies and mappings come in by joins, nothing is grouped.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.category_rules import category_named
from tidemark.functions.text import nfkc
from tidemark.operators.classification import SAFE_LABELS

UNCLASSIFIED = "unclassified"

# Category, its group, its place there, its name. Groups and the last one are never an answer; the last is no filter.
TREE = """
amplifier - 1 アンプ
integrated_amp amplifier 1 プリメインアンプ
pre_amp amplifier 2 プリアンプ
power_amp amplifier 3 パワーアンプ
headphone_amp amplifier 4 ヘッドホンアンプ
av_amp amplifier 5 AVアンプ
digital - 2 デジタル
dac digital 1 DAC
network_player digital 2 ネットワークプレーヤー
cd_sacd_player digital 3 CD/SACDプレーヤー
transport digital 4 トランスポート
dap digital 5 DAP
network_switch digital 6 スイッチングハブ
optical_isolator digital 7 光アイソレーター
router digital 8 ルーター
music_server digital 9 ミュージックサーバー
master_clock digital 10 マスタークロックジェネレーター
analog - 3 アナログ
turntable analog 1 レコードプレーヤー
tonearm analog 2 トーンアーム
cartridge analog 3 カートリッジ
headshell cartridge 1 ヘッドシェル
phono_eq analog 4 フォノイコライザー
phono_step_up_transformer analog 5 昇圧トランス
speaker - 4 スピーカー
speaker_bookshelf speaker 1 ブックシェルフ
speaker_floorstanding speaker 2 フロア型・トールボーイ
center_speaker speaker 3 センタースピーカー
subwoofer speaker 4 サブウーファー
active_speaker speaker 5 アクティブスピーカー
headphone_group - 5 ヘッドホン
wired_headphone headphone_group 1 有線ヘッドホン
wired_earphone headphone_group 2 有線イヤホン
btw_headphone headphone_group 3 BTWヘッドホン
btw_earphone headphone_group 4 BTWイヤホン
accessories - 6 アクセサリー
cable accessories 1 ケーブル
cable_xlr cable 1 XLRケーブル
cable_rca cable 2 RCAケーブル
cable_phono cable 3 フォノケーブル
cable_usb cable 4 USBケーブル
cable_lan cable 5 LANケーブル
cable_digital cable 6 デジタルケーブル
cable_power cable 7 電源ケーブル
cable_other cable 8 その他ケーブル
rack accessories 2 オーディオラック
power_strip accessories 3 電源タップ
clean_power accessories 4 クリーン電源
vacuum_tube accessories 5 真空管
other_accessory accessories 6 その他アクセサリー
dj_dtm - 7 DJ機器・DTM
other - 8 その他
unclassified - 99 未分類
"""
GROUPS = ("amplifier", "digital", "analog", "speaker", "headphone_group", "accessories", "cable")
# What else labels call a category.
WORDINGS = {
    "pre_amp": "control amp, linestage preamplifier, コントロールアンプ",
    "av_amp": "av receiver, audio video receiver, AVレシーバー",
    "dac": "d/a converter, d/aコンバーター",
    "network_player": "network cd receiver, streamer, streaming player, ネットワーク",
    "cd_sacd_player": "cd player, sacd player, sacd/cd player, cdプレーヤー, sacdプレーヤー, sacd/cdプレーヤー",
    "transport": "cd transport, sacd transport, super audio cd transport, disc transport, network transport, network audio transport, streaming transport, "
    "cdトランスポート, sacdトランスポート, cd/sacdトランスポート, ネットワークトランスポート, ネットワークオーディオトランスポート, ストリーミングトランスポート",
    "dap": "digital audio player, デジタルオーディオプレーヤー, ポータブルプレーヤー",
    "network_switch": "ethernet switch, switching hub, ネットワークスイッチ",
    "optical_isolator": "fiber isolator, 光絶縁",
    "router": "audio router, オーディオルーター",
    "music_server": "audio server, music library server, オーディオサーバー",
    "master_clock": "master clock generator, clock generator, マスタークロック, クロックジェネレーター",
    "turntable": "record player, ターンテーブル, アナログプレーヤー",
    "phono_eq": "phono equalizer, phono stage, フォノアンプ",
    "phono_step_up_transformer": "step-up transformer, mc transformer, moving coil transformer, mc昇圧トランス",
    "speaker_bookshelf": "bookshelf, bookshelf speaker, standmount, ブックシェルフ型",
    "speaker_floorstanding": "floorstanding, tower speaker, トールボーイ, フロア型, フロアスタンディング",
    "center_speaker": "center channel speaker",
    "active_speaker": "powered speaker, powered monitor, パワードスピーカー",
    "wired_earphone": "wired earbud",
    "btw_headphone": "bluetooth headphone, wireless headphone, bluetoothヘッドホン, ワイヤレスヘッドホン",
    "btw_earphone": "bluetooth earphone, wireless earphone, wireless earbud, true wireless, tws, bluetoothイヤホン, ワイヤレスイヤホン, 完全ワイヤレスイヤホン",
    "cable_xlr": "xlr cable, xlr interconnect, xlrインターコネクト",
    "cable_rca": "rca cable, rca interconnect, rcaインターコネクト",
    "cable_phono": "phono cable, phono interconnect, tonearm cable, トーンアームケーブル",
    "cable_usb": "usb cable, オーディオusbケーブル",
    "cable_lan": "lan cable, ethernet cable, network cable, オーディオlanケーブル, イーサネットケーブル",
    "cable_digital": "digital cable, digital interconnect, spdif cable, aes/ebu cable, toslink cable, optical cable, coaxial digital cable, hdmi cable, "
    "デジタル同軸ケーブル, 光デジタルケーブル, hdmiケーブル",
    "cable_power": "power cable, power cord, mains cable, ac cable, 電源コード, acケーブル",
    "cable_other": "other cable, speaker cable, headphone cable, スピーカーケーブル, ヘッドホンケーブル",
    "rack": "audio rack, ラック",
    "power_strip": "power distributor, power distribution, 電源ボックス",
    "clean_power": "power conditioner, power regenerator, ac regenerator, 電源コンディショナー, 電源リジェネレーター",
    "vacuum_tube": "tube",
    "other_accessory": "insulator, hdmi switcher, dust cover, インシュレーター, hdmiスイッチャー, ダストカバー",
    "dj_dtm": "dj, ddj, dtm, rekordbox, serato, midi, オーディオインターフェース",
    "other": "tuner, equalizer, channel divider, frequency dividing network, チューナー, イコライザー, チャンネルデバイダー",
    "analog": "analogue",
    "digital": "digital audio",
    "headphone_group": "ヘッドホン・イヤホン",
}
# Names of before, taken as they stand; as an answer, and as a filter.
FORMER = {
    "network_transport": "transport", "cd_sacd_transport": "transport", "accessory": "other_accessory", "speaker_other": "other",
    "headphone": "wired_headphone", "earphone": "wired_earphone", "power_accessory": "clean_power",
}
FORMER_ANSWER, FORMER_FILTER = FORMER | {"cable": "cable_other"}, FORMER | {"speaker_other": "speaker"}
# Labels of shops that are too broad to decide by themselves.
BROAD = ("other", "other_accessory", "cable_other", "wired_headphone", "wired_earphone", "clean_power", "cartridge")
# What a label's key leaves out, and spellings that mean the same.
LEFT_OUT = r"[\s・･_\-/()（）]+"
SPELLINGS = (("amp", "amplifier"), ("center", "centre"), ("fiber", "fibre"), ("プレーヤー", "プレイヤー"))

_EVIDENCE = "array<struct<category_id: string, source: string, strength: string, value: string, plain: string>>"


def rows() -> list[tuple[str, str | None, int, str]]:
    """(category, group, place, name), in the tree's own order."""
    out = (line.split(" ", 3) for line in TREE.strip().split("\n"))
    return [(i, None if g == "-" else g, int(n), name) for i, g, n, name in out]


def taxonomy(spark: SparkSession) -> DataFrame:
    """(category_id, name, parent_id, place, classifiable, filterable)."""
    made = [(i, name, g, n, i not in (*GROUPS, UNCLASSIFIED), i != UNCLASSIFIED) for i, g, n, name in rows()]
    return spark.createDataFrame(made, "category_id string, name string, parent_id string, place int, classifiable boolean, filterable boolean")


def _fold(label: str) -> str:
    return re.sub(LEFT_OUT, "", unicodedata.normalize("NFKC", label).strip().lower())


def _spelled(label: str) -> set[str]:
    """The label, with other spellings of its words, as a plural, without a long vowel at its end."""
    out = {label}
    for a, b in SPELLINGS:
        out |= {x.replace(a, b) for x in out if a in x and b not in x}
    out |= {x + "s" for x in out if x[-1].isascii() and x[-1].isalpha()}
    return out | {x[:-1] for x in out if x.endswith("ー")}


@functools.cache
def labels(answers_only: bool = True) -> dict[str, str]:
    """Folded label -> category; of categories that claim one label the first in the tree has it."""
    out: dict[str, str] = {}
    for i, _, _, name in rows():
        if i == UNCLASSIFIED or (answers_only and i in GROUPS):
            continue
        words = [i.replace("_", " "), name, *WORDINGS.get(i, "").split(", ")]
        for x in itertools.chain.from_iterable(_spelled(w) for w in words if w):
            out.setdefault(_fold(x), i)
    return out


def _each(texts: pa.Array, f) -> pa.Array:
    """f of each text, of texts that repeat within a batch once; labels repeat a lot."""
    coded = texts.dictionary_encode()
    return pa.array([f(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(StringType())
def label_key(texts: pa.Array) -> pa.Array:
    """A label for comparison: folded, without separators."""
    return _each(texts, _fold)


@F.arrow_udf(StringType())
def answer(texts: pa.Array) -> pa.Array:
    """The category that a label stands for, null if none or a group."""
    return _each(texts, lambda t: FORMER_ANSWER.get(t) or labels().get(_fold(t)))


def closure(category_id: str) -> list[str]:
    """The category and the groups above it; nothing for what is no answer."""
    up = {i: g for i, g, _, _ in rows()}
    at = FORMER_FILTER.get(category_id, category_id)
    out = []
    while at and at in up and (out or at not in (*GROUPS, UNCLASSIFIED)):
        out.append(at)
        at = up[at]
    return out


def filter_ids(label: str) -> list[str]:
    """All category ids, those of before included, that a filter on this label accepts: the category and all below it."""
    at = FORMER_FILTER.get(label, label)
    if at not in {i for i, *_ in rows() if i != UNCLASSIFIED}:
        at = labels(False).get(_fold(label))
    if not at:
        return []
    found = [i for i, *_ in rows() if i == at or at in closure(i)]
    return found + [k for k, v in FORMER.items() if v in found and k not in found]


def in_category(c: Column, label: str) -> Column:
    """True where the category is the one of the label or lies below it."""
    return c.isin(filter_ids(label))


def evidence(listings: DataFrame, policies: DataFrame | None = None, overrides: DataFrame | None = None, mappings: DataFrame | None = None) -> DataFrame:
    """listings with `evidence`: array of (category_id, source, strength, value, plain), what the shop's label, the title and a hint say.

    listings: shop_key, title, raw_category, hinted_category. policies: shop_key, seller_default, parser_hint, each one of authoritative,
    corroborative, ignore (else authoritative for labels, corroborative for hints). overrides: shop_key, category_id, mode for labels of that
    category. mappings: shop_key, raw_category, category, position (the first of equal labels counts).

    A label counts as its mapping says, else as a label of the tree, else as the rules read it. What rules read, and broad
    categories, corroborate only, unless an override says more. Hints count where there is no label, and never for `other`.
    """
    spark = listings.sparkSession
    policies = spark.createDataFrame([], "shop_key string, seller_default string, parser_hint string") if policies is None else policies
    overrides = spark.createDataFrame([], "shop_key string, category_id string, mode string") if overrides is None else overrides
    mappings = spark.createDataFrame([], "shop_key string, raw_category string, category string, position int") if mappings is None else mappings
    c = F.col
    said = lambda name: F.coalesce(c(name), F.lit(""))
    out = listings.withColumns({
        "_plain": F.lower(F.trim(nfkc(said("raw_category")))), "_key": label_key(c("raw_category")), "_alias": answer(said("raw_category")), "_rule": category_named(c("raw_category")),
        "_title": category_named(c("title")), "_hint": F.coalesce(answer(said("hinted_category")), category_named(c("hinted_category"))),
    })
    meant = mappings.withColumn("_key", label_key(c("raw_category"))).where("_key <> ''")
    meant = meant.groupBy("shop_key", "_key").agg(F.min_by(answer(c("category")), "position").alias("_mapped"))
    out = out.join(meant, ["shop_key", "_key"], "left")
    out = out.withColumn("_seller", F.coalesce("_mapped", "_alias", F.nullif(c("_rule"), F.lit(""))))
    modes = overrides.select("shop_key", c("category_id").alias("_seller"), c("mode").alias("_mode"))
    out = out.join(modes, ["shop_key", "_seller"], "left").join(policies.select("shop_key", c("seller_default").alias("_default"), c("parser_hint").alias("_by_hint")), "shop_key", "left")
    known = lambda col, otherwise: F.when(col.isin("authoritative", "corroborative", "ignore"), col).otherwise(otherwise)
    read = c("_mapped").isNull() & c("_alias").isNull()
    general = F.when(read | c("_seller").isin(*BROAD), "corroborative").otherwise(known(c("_default"), F.lit("authoritative")))
    item = lambda category, source, strength, value, plain=F.lit(None): F.struct(category.alias("category_id"), F.lit(source).alias("source"), strength.alias("strength"), F.substring(value, 1, 240).alias("value"), plain.alias("plain"))
    strength = lambda mode: F.when(mode == "authoritative", "authoritative").when(mode == "corroborative", "supporting")
    by_label, by_hint = strength(known(c("_mode"), general)), strength(known(c("_by_hint"), F.lit("corroborative")))
    found = F.array_compact(F.array(
        F.when((said("raw_category") != "") & c("_seller").isNotNull() & by_label.isNotNull(), item(c("_seller"), "seller_category", by_label, said("raw_category"), c("_plain"))),
        F.when(c("_title") != "", item(c("_title"), "title", F.lit("strong"), said("title"))),
        F.when((said("raw_category") == "") & (said("hinted_category") != "") & ~c("_hint").isin("", "other") & by_hint.isNotNull(), item(c("_hint"), "parser_hint", by_hint, said("hinted_category"))),
    ))
    return out.select(*listings.columns, found.cast(_EVIDENCE).alias("evidence"))


def decide(listings: DataFrame, tiers: tuple[str, ...] = ("verified", "authoritative", "strong"), safe_labels: dict[str, str] | None = None) -> DataFrame:
    """listings with category_id, state, source, candidates from their `evidence`, as `classification.classify` decides over rows of evidence.

    The strongest tier with evidence decides: one category, or ambiguous. Else supporting labels that are safe decide, if all agree.
    """
    safe_labels = SAFE_LABELS if safe_labels is None else safe_labels
    of = lambda t: F.filter("evidence", lambda x: x.strength == t)
    out = listings.withColumns({"_weak": F.filter("evidence", lambda x: ~x.strength.isin(*tiers)), **{f"_tier{i}": of(t) for i, t in enumerate(tiers)}})
    is_safe = lambda x: F.coalesce(*(F.when((x.plain == k) & (x.category_id == v), True) for k, v in safe_labels.items()), F.lit(False))
    safe = F.exists("_weak", lambda x: (x.source == "seller_category") & is_safe(x))
    some = lambda i: F.when(F.size(f"_tier{i}") > 0, F.col(f"_tier{i}"))
    out = out.withColumn("_deciding", F.coalesce(*map(some, range(len(tiers))), F.when(safe, F.col("_weak"))))
    out = out.withColumn("_ids", F.array_distinct(F.transform(F.coalesce("_deciding", "evidence"), lambda x: x.category_id)))
    state = F.when(F.col("_deciding").isNull(), "unclassified").when(F.size("_ids") == 1, "classified").otherwise("ambiguous")
    out = out.withColumn("state", state)
    sure = F.col("state") == "classified"
    return out.select(
        *listings.columns, F.when(sure, F.element_at("_ids", 1)).otherwise(UNCLASSIFIED).alias("category_id"), "state",
        F.when(sure, F.array_join(F.array_distinct(F.transform("_deciding", lambda x: x.source)), "+")).otherwise(F.col("state")).alias("source"),
        F.when(sure, F.array().cast("array<string>")).otherwise(F.col("_ids")).alias("candidates"),
    )


# Shelf labels by wording, the first match wins, and the one for everything else.
SHELVES = (
    ("スピーカー", r"speaker|スピーカー|monitor\s*audio|bookshelf"),
    ("プリメインアンプ", r"integrated|プリメイン|pma-|ma\d|a-\d"),
    ("プリアンプ", r"preamp|pre amplifier|プリアンプ|control amplifier"),
    ("パワーアンプ", r"power amp|パワーアンプ"),
    ("DAC", r"\bdac\b|d/a|d-a|コンバータ|converter|wandla|tambaqui"),
    ("ネットワーク", r"network|streamer|streaming|ネットワーク|rivo|zen stream"),
    ("CD/SACDプレーヤー", r"sacd|cd player|cdプレーヤ|dcd-"),
    ("アナログ", r"turntable|record player|phono|ターンテーブル|レコード|カートリッジ"),
    ("イヤホン", r"earphone|イヤホン|iem\b"),
    ("ヘッドホン", r"headphone|ヘッドホン|stax|d8000|susvara"),
    ("DAP・ヘッドホンアンプ", r"\bdap\b|digital audio player|ポータブルプレーヤ"),
    ("DJ機器・DTM", r"\bdj\b|\bddj[-\s]|rekordbox|serato|オーディオインターフェース|midi"),
    ("ケーブル・アクセサリー", r"cable|ケーブル|usb|電源|insulator|インシュレータ|アクセサリ"),
)
OTHER_SHELF = "その他"


def shelf(title: Column, hint: Column) -> Column:
    """The label to show before a listing is classified: the hint, else the first wording that the title holds."""
    # \b has to mean the ends of ASCII words
    ends = lambda p: "(?i)" + p.replace(r"\b", r"(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))")
    text = F.coalesce(title, F.lit(""))
    return F.coalesce(F.nullif(hint, F.lit("")), *(F.when(text.rlike(ends(p)), name) for name, p in SHELVES), F.lit(OTHER_SHELF))
