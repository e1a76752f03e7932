"""Categories from evidence by tiers, and feature facts from titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import nfkc

# Seller labels that may decide alone, and the wording of features (words end at what is no ASCII word character).
SAFE_LABELS = {"アクセサリー": "other_accessory", "ケーブル": "cable_other", "カートリッジ": "cartridge", "cartridge": "cartridge"}
FEATURES = {
    "dac": r"(?i)(?<![a-z0-9_])dac(?![a-z0-9_])|dac\s*(内蔵|搭載)|d\s*[/-]\s*a\s*(converter|コンバーター?)|da\s*コンバーター?",
    "network_playback": r"(?i)network\s+(player|transport|streaming)|streamer|streaming\s+(player|transport)|ネットワーク(再生|対応|プレーヤー|プレイヤー|トランスポート)",
    "headphone_output": r"(?i)headphone\s*(out|output|jack)|ヘッドホン(出力|端子)",
    "phono_input": r"(?i)phono\s*(in|input)|フォノ入力",
}


def classify(evidence: DataFrame, tiers: list[str], safe_labels: dict[str, str] = SAFE_LABELS) -> DataFrame:
    """evidence: listing_id, position, category_id, source, strength, value. tiers: the strengths that decide, strongest first.

    The strongest tier with evidence decides: one category, or ambiguous. Without any, other evidence decides only if it is
    a safe seller label and all of it agrees. Returns (listing_id, category_id, state, source, candidates).
    """
    rows = evidence.where(F.coalesce("category_id", F.lit("")) != "")
    rank = F.coalesce(*(F.when(F.col("strength") == t, i) for i, t in enumerate(tiers)), F.lit(len(tiers)))
    label = F.lower(F.trim(nfkc(F.coalesce("value", F.lit("")))))
    safe = (F.col("source") == "seller_category") & F.coalesce(*((F.when(label == k, F.col("category_id") == v)) for k, v in safe_labels.items()), F.lit(False))
    # a row for each category and source of a tier, before the listing's rows meet
    rows = rows.select("listing_id", rank.alias("tier"), "category_id", "source", "position", safe.alias("safe"))
    rows = rows.groupBy("listing_id", "tier", "category_id", "source").agg(F.min("position").alias("position"), F.max("safe").alias("safe"))
    tier = rows.groupBy("listing_id", "tier").agg(
        F.sort_array(F.collect_set("category_id")).alias("ids"), F.max("safe").alias("safe"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "source"))), lambda x: x.source)), "+").alias("sources"),
    )
    best = tier.groupBy("listing_id").agg(F.min_by(F.struct("tier", "ids", "safe", "sources"), "tier").alias("b"))
    weak, one = F.col("b.tier") == len(tiers), F.size("b.ids") == 1
    state = F.when(one & (~weak | F.col("b.safe")), "classified").when(~weak | F.col("b.safe"), "ambiguous").otherwise("unclassified")
    return best.select(
        "listing_id", F.when(state == "classified", F.element_at("b.ids", 1)).otherwise("unclassified").alias("category_id"), state.alias("state"),
        F.when(state == "classified", F.col("b.sources")).otherwise(state).alias("source"),
        F.when(state == "classified", F.array().cast("array<string>")).otherwise(F.col("b.ids")).alias("candidates"),
    )


def feature_facts(listings: DataFrame, features: dict[str, str] = FEATURES, confidence: float = 0.8) -> DataFrame:
    """(listing_id, feature, state, source, confidence) for each feature that a title names."""
    title = nfkc(F.coalesce("title", F.lit("")))
    rows = listings.select("listing_id", title.alias("_t"))
    found = F.array_compact(F.array(*(F.when(F.col("_t").rlike(p), F.lit(f)) for f, p in features.items())))
    level = F.lit(min(1.0, max(0.0, confidence)))
    return rows.select("listing_id", F.explode(found).alias("feature")).select("listing_id", "feature", F.lit("present").alias("state"), F.lit("title").alias("source"), level.alias("confidence"))


def sync_facts(stored: DataFrame, found: DataFrame, listings: DataFrame) -> DataFrame:
    """Facts after the listings were read again: what titles said is replaced, what other sources said stays; one a feature and source."""
    again = listings.select("listing_id").distinct().withColumn("source", F.lit("title"))
    rows = stored.join(again, ["listing_id", "source"], "left_anti").withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("listing_id", "feature", "source").orderBy(F.desc("_new"), F.desc("confidence"), "state")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")
