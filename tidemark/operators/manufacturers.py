"""Which manufacturer a listing names: aliases met by key, and brands at the start of titles, as joins with the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_space, nfkc

# Condition labels before a name, words for "no maker", company suffixes, separators inside a name.
LABELS = r"(?i)^((【|〖|\[)\s*(中古(品)?|新品|展示(処分)?品?|特価(商品|品)?|未使用(開封)?品?|B級品|アウトレット(品)?|現品処分品)\s*(】|〗|\])\s*)+"
NO_MAKER = r"^(不明(\s+.*)?|メーカー不明|その他|ノーブランド)$"
COMPANY = r"(?i)\b(co\.?\s*,?\s*ltd\.?|corporation|corp\.?|inc\.?|limited|ltd\.?)\b|株式会社|有限会社|合同会社"
SEPARATOR = r"[\s・･_\-/&+.,'\"()（）]"


def _plain(c: Column) -> Column:
    return collapse_space(nfkc(F.coalesce(c, F.lit(""))))


def placeholder(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, LABELS, "")).rlike(NO_MAKER)


def manufacturer_key(plain: Column) -> Column:
    """A name for comparison, from its plain form: no labels, company suffixes or separators; empty for "no maker"."""
    stripped = F.trim(F.regexp_replace(plain, LABELS, ""))
    key = F.regexp_replace(F.regexp_replace(F.lower(stripped), COMPANY, ""), SEPARATOR + "+", "")
    return F.when(placeholder(plain), "").otherwise(key)


def _tokens(plain: Column) -> Column:
    return F.filter(F.split(plain, SEPARATOR + "+"), lambda x: x != "")


def _starts(tokens: Column) -> Column:
    """The pattern of texts that begin with these tokens, whatever separates them, and then end or go on with a separator."""
    quoted = F.transform(tokens, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    return F.concat(F.lit("(?iu)^"), F.array_join(quoted, SEPARATOR + "*"), F.lit(f"(?=$|{SEPARATOR})"))


def resolve(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """listings: listing_id, raw_manufacturer, manufacturer_candidate, title. aliases: manufacturer_id, canonical_name, alias,
    verification_status, source. Returns (listing_id, manufacturer_id, display_name, status, method, candidate_ids).

    Evidence in this order, the first that says something decides: the raw name's key; the candidate's key; a brand that begins
    the title and that the given name is cut off from; without any name, the longest brand that begins the title. Several
    verified makers: candidate, ambiguous_alias. Only pending ones: candidate, unverified_alias. A "no maker" word: unresolved.

    Titles meet the vocabulary by equality on their first words run together, as many as an alias has at most; so the
    vocabulary may grow, and no title is held against every alias.
    """
    names = aliases.withColumn("_a", _plain(F.col("alias"))).withColumns({"_t": _tokens(F.col("_a"))})
    names = names.withColumns({"_key": manufacturer_key(F.col("_a")), "_joined": F.lower(F.array_join("_t", "")), "_p": _starts(F.col("_t"))})
    names = names.select("manufacturer_id", "canonical_name", "verification_status", "source", "_a", "_key", "_joined", "_p", F.size("_t").alias("_n"))
    most = names.agg(F.max("_n")).first()[0] or 1
    rows = listings.select("listing_id", *(_plain(F.col(c)).alias(f"_{c[0]}") for c in ("raw_manufacturer", "manufacturer_candidate", "title")))
    rows = rows.withColumns({"_none": placeholder(F.col("_r")) | placeholder(F.col("_m")), "_rk": manufacturer_key(F.col("_r")), "_ck": manufacturer_key(F.col("_m"))})
    ask = rows.where("NOT _none")
    kept = ["manufacturer_id", "canonical_name", "verification_status", "source"]
    by_raw = ask.where("_rk <> ''").join(names, F.col("_rk") == F.col("_key")).select("listing_id", F.lit(1).alias("stage"), *kept)
    by_candidate = ask.where("_ck <> '' AND _ck <> _rk").join(names, F.col("_ck") == F.col("_key")).select("listing_id", F.lit(2).alias("stage"), *kept)

    words = ask.withColumn("_t0", F.slice(_tokens(F.col("_t")), 1, most))
    first = F.transform(F.sequence(F.lit(1), F.size("_t0")), lambda i: F.lower(F.array_join(F.slice("_t0", 1, i), "")))
    words = words.where(F.size("_t0") > 0).withColumn("_joined", F.explode(F.array_distinct(first))).drop("_t0")
    begun = words.join(names, "_joined").where(F.rlike("_t", F.col("_p")))
    named = (F.col("_rk") != "") | (F.col("_ck") != "")

    def cut_off(name: str, key: str) -> Column:
        return (F.length(key) >= 2) & (F.col(key) != F.col("_key")) & F.rlike("_a", _starts(_tokens(F.col(name))))

    begun = begun.where(~named | cut_off("_r", "_rk") | cut_off("_m", "_ck")).withColumn("stage", F.when(named, 3).otherwise(4))
    longest = F.max(F.length("_key")).over(Window.partitionBy("listing_id", "stage"))
    begun = begun.withColumn("_l", longest).where(F.col("_l") == F.length("_key")).select("listing_id", "stage", *kept)

    sure, open_ = F.col("verification_status") == "verified", F.col("verification_status") == "pending"
    found = by_raw.unionByName(by_candidate).unionByName(begun).groupBy("listing_id", "stage").agg(
        F.sort_array(F.collect_set(F.when(sure, F.col("manufacturer_id")))).alias("ids"), F.sort_array(F.collect_set(F.when(open_, F.col("manufacturer_id")))).alias("pending"),
        F.min(F.when(sure, F.col("canonical_name"))).alias("name"), F.max(sure & (F.col("source") != "code_bootstrap")).alias("live"),
    )
    found = found.where((F.size("ids") > 0) | (F.size("pending") > 0))
    found = found.groupBy("listing_id").agg(F.min_by(F.struct("stage", "ids", "pending", "name", "live"), "stage").alias("f"))
    out = rows.join(found, "listing_id", "left")
    one, some = F.size("f.ids") == 1, F.col("f").isNotNull()
    kind = F.concat(F.when(F.col("f.stage") >= 3, "title_").otherwise(""), F.when(F.col("f.live"), "verified_alias").otherwise("bootstrap_alias"))
    said = F.when(F.col("f.stage") == 2, F.col("_m")).when(F.col("f.stage") == 1, F.col("_r")).when(F.col("f.stage") == 3, F.when(F.col("_r") != "", F.col("_r")).otherwise(F.col("_m"))).otherwise("")
    return out.select(
        "listing_id",
        F.when(some & one, F.element_at("f.ids", 1)).otherwise("").alias("manufacturer_id"),
        F.when(F.col("_none"), "").when(some & one, F.coalesce("f.name", said)).when(some, said).otherwise(F.when(F.col("_m") != "", F.col("_m")).otherwise(F.col("_r"))).alias("display_name"),
        F.when(some & one, "resolved").when(some, "candidate").otherwise("unresolved").alias("status"),
        F.when(some & one, kind).when(some & (F.size("f.ids") > 1), "ambiguous_alias").when(some, "unverified_alias").otherwise("none").alias("method"),
        F.when(some & ~one, F.when(F.size("f.ids") > 1, F.col("f.ids")).otherwise(F.col("f.pending"))).otherwise(F.array().cast("array<string>")).alias("candidate_ids"),
    )


def unresolved_groups(listings: DataFrame, n: int = 50) -> DataFrame:
    """The spellings that stand for most unresolved active listings. listings: is_active, manufacturer_status, manufacturer_key, raw_manufacturer, shop_key."""
    rows = listings.where(F.col("is_active") & (F.col("manufacturer_status") != "resolved"))
    out = rows.groupBy("manufacturer_key").agg(F.min("raw_manufacturer").alias("sample"), F.count("*").alias("listings"), F.count_distinct("shop_key").alias("shops"))
    return out.orderBy(F.desc("listings"), F.desc("shops"), "manufacturer_key").limit(min(200, max(1, n)))
