"""Which product of the catalog a listing's model names: by its name, by names derived from it, by aliases; a name of two products is nobody's.

Names are keys: products claim theirs by rank, listings ask for theirs in order, and both meet in one join of distinct names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import nfkc

# What sellers put behind a model (notes, states, stock numbers, colours), by pattern, in order; each only at the end but the first.
NOTES = (r"\s*《[^》]{1,40}》\s*", r"(?i)\s*【[^】]*(?:販売済|売約|SOLD(?:\s*OUT)?|売切|品切)[^】]*】\s*$", r"(?i)\s*\[[A-Z0-9][A-Z0-9._/-]{3,}\]\s*$")
COLOURS = "ブラック|ホワイト|シルバー|ゴールド|レッド|ブルー|ブラウン|黒|白|銀|black|white|silver|gold"
SHORT_COLOURS = "B|S|BK|WH|W|K|ブラック|ホワイト|シルバー|黒|白|銀"
# Maker, models that it sells under market codes, the code; and maker, models that shops write without their space.
MARKETS = (("denon", r"^(?:AH|AVR|AVC|DCD|DHT|DNP|DP|PMA|RCD)-", r"-(?:BK|SP|K|W|WH)$"), ("denon", r"^AH-[A-Z0-9-]+EM$", r"EM$"), ("marantz", "", r"/F[BN]$"))
SPACED = (("marantz", r"^(SACD|CD|MODEL|AV|AMP|LINK)(\d+[A-Z]*)$"),)

EXACT, DERIVED, ALIAS = "exact", "derived_alias", "alias"


def plain_model(c: Column) -> Column:
    """A model for comparison: upper case, one kind of dash, single spaces, none around dashes, dots, slashes and underlines."""
    c = F.translate(F.upper(F.coalesce(c, F.lit(""))), "‐‑‒–—―－", "-" * 7)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r" ?([./_-]) ?", "$1"))


def with_variants(rows: DataFrame, maker: str, model: str, name: str, own: str | None = None) -> DataFrame:
    """rows with an array of the names that their model may be looked up by, the shortest first: as given, without notes, without a
    colour, without its maker's market code, with its maker's spacing, and the part before a +. Revisions of a product stay.
    own: a column for the name as given, which may be empty."""
    c = F.col
    out = rows.withColumns({"_v0": F.trim(nfkc(F.coalesce(c(model), F.lit("")))), "_maker": F.lower(F.trim(F.coalesce(c(maker), F.lit(""))))})
    text = c("_v0")
    for note in NOTES:
        text = F.regexp_replace(text, note, " ")
    out = out.withColumn("_v1", F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    text = F.regexp_replace("_v1", rf"(?i)\s*/\s*(?:{COLOURS})(?:\s*[（(]?(?:ペア|pair)[）)]?)?\s*$", "")
    out = out.withColumn("_v2", plain_model(F.regexp_replace(text, rf"(?i)\s*[（(](?:{SHORT_COLOURS})[）)]\s*$", "")))
    cut = c("_v2")
    for who, models, code in MARKETS:
        # of a maker's codes the first that applies goes
        cut = F.when((c("_maker") == who) & c("_v2").rlike(models) & (cut == c("_v2")), F.regexp_replace("_v2", code, "")).otherwise(cut)
    # names that are used again are columns, so that each pattern runs once a row
    out = out.withColumns({"_v3": cut, "_own": plain_model(c("_v0"))})
    spaced = F.array(*(F.when((c("_maker") == who) & c("_v3").rlike(p), F.regexp_replace("_v3", p, "$1 $2")) for who, p in SPACED))
    base = F.when(F.instr("_v3", "+") > 1, plain_model(F.substring_index("_v3", "+", 1)))
    all_ = F.array_compact(F.concat(F.array(c("_own"), plain_model(c("_v1")), c("_v2"), c("_v3"), base), spaced))
    by_size = F.array_sort(F.transform(F.array_distinct(F.filter(all_, lambda x: x != "")), lambda x: F.struct(F.length(x), x.alias("x"))))
    names = F.transform(by_size, lambda s: s.x)
    out = out.withColumn(name, names).drop("_v0", "_v1", "_v2", "_v3", "_maker")
    return out.withColumnRenamed("_own", own) if own else out.drop("_own")


def index(products: DataFrame, aliases: DataFrame, derived: bool = True) -> DataFrame:
    """(manufacturer_id, key, product_id, match_type): the names that exactly one product claims, at its best rank.

    products: product_id, manufacturer_id, canonical_model, normalized_model. aliases: product_id, alias.
    """
    own = products.select("product_id", F.lower(F.trim("manufacturer_id")).alias("manufacturer_id"), "canonical_model", plain_model(nfkc("normalized_model")).alias("key"))
    named = with_variants(own, "manufacturer_id", "canonical_model", "_names") if derived else own.withColumn("_names", F.array().cast("array<string>"))
    claims = named.select("product_id", "manufacturer_id", F.posexplode(F.array_prepend("_names", F.col("key"))).alias("rank", "key")).withColumn("rank", F.least("rank", F.lit(1)))
    given = aliases.join(own.select("product_id", "manufacturer_id"), "product_id")
    claims = claims.unionByName(given.select("product_id", "manufacturer_id", plain_model(nfkc("alias")).alias("key"), F.lit(2).alias("rank")))
    one = claims.where("key <> '' AND manufacturer_id <> ''").groupBy("manufacturer_id", "key").agg(F.min("product_id").alias("product_id"), F.max("product_id").alias("_other"), F.min("rank").alias("rank"))
    return one.where("product_id = _other").select("manufacturer_id", "key", "product_id", F.element_at(F.array(*map(F.lit, (EXACT, DERIVED, ALIAS))), F.col("rank") + 1).alias("match_type"))


def _keys(rows: DataFrame) -> DataFrame:
    """The products of rows, for a semi join. Never broadcast: ids are small in files, so any number of them is taken for few, and each takes many times its bytes on the driver."""
    return rows.select("product_id").hint("merge")


def matches(listings: DataFrame, products: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """(listing_id, product_id, match_type, matched_name, category_ids): verified products that listings with a resolved model name.

    listings: listing_id, manufacturer_id, model, model_status (resolved, or empty where nothing resolves models). products: as for index, with verification_status. categories:
    product_id, category_id, is_primary; only products with a primary one match; it comes first. A listing's own name counts before names derived from it.
    """
    sorted_ = F.array_sort(F.collect_set(F.struct((~F.col("is_primary")).alias("later"), "category_id")))
    kinds = categories.groupBy("product_id").agg(F.transform(sorted_, lambda x: x.category_id).alias("category_ids"), F.bool_or("is_primary").alias("_has")).where("_has").drop("_has")
    live = products.where("verification_status = 'verified'").join(_keys(kinds), "product_id", "left_semi")
    found = index(live, aliases)
    rows = listings.where(F.coalesce("model_status", F.lit("")).isin("", "resolved")).select("listing_id", F.lower(F.trim("manufacturer_id")).alias("manufacturer_id"), "model")
    asked = with_variants(rows.select("manufacturer_id", "model").distinct(), "manufacturer_id", "model", "_names", "_key")
    keys = asked.select("manufacturer_id", "model", F.posexplode(F.array_prepend("_names", F.col("_key"))).alias("at", "key"))
    met = keys.join(found, ["manufacturer_id", "key"])
    kind = F.when(F.col("at") == 0, F.col("match_type")).otherwise(DERIVED)  # the own name, wherever it stands again, meets at 0 too
    best = met.groupBy("manufacturer_id", "model").agg(F.min_by(F.struct("product_id", kind.alias("match_type"), F.col("key").alias("matched_name")), "at").alias("m"))
    out = rows.join(best, ["manufacturer_id", "model"]).select("listing_id", "m.product_id", "m.match_type", "m.matched_name")
    return out.join(kinds, "product_id").select("listing_id", "product_id", "match_type", "matched_name", "category_ids")


def manual_matches(listings: DataFrame, products: DataFrame, aliases: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """(listing_id, product_id, match_type, category_id): what people have verified decides the category of listings whose model is not resolved.

    sources: product_id, source_type, status. Only the product's name and its aliases count, as they stand, and its primary category.
    """
    by_hand = sources.where("source_type = 'manual_verified' AND status = 'active'").select("product_id")
    primary = categories.where("is_primary").groupBy("product_id").agg(F.min("category_id").alias("category_id"))
    live = products.where("verification_status = 'verified'").join(_keys(by_hand), "product_id", "left_semi").join(_keys(primary), "product_id", "left_semi")
    rows = listings.where(~F.coalesce("model_status", F.lit("")).isin("", "resolved"))
    rows = rows.select("listing_id", F.lower(F.trim("manufacturer_id")).alias("manufacturer_id"), plain_model(nfkc("model")).alias("key"))
    return rows.join(index(live, aliases, derived=False), ["manufacturer_id", "key"]).join(primary, "product_id").select("listing_id", "product_id", "match_type", "category_id")


def identity_candidates(products: DataFrame, aliases: DataFrame) -> DataFrame:
    """(product_id, manufacturer_id, canonical_model, aliases) of verified products for `resolution.resolve`: aliases as given, and names derived from the model."""
    live = with_variants(products.where("verification_status = 'verified'").select("product_id", "manufacturer_id", "canonical_model"), "manufacturer_id", "canonical_model", "_names")
    given = aliases.groupBy("product_id").agg(F.collect_set("alias").alias("_given"))
    out = live.join(given, "product_id", "left")
    names = F.array_except(F.array_union(F.coalesce("_given", F.array().cast("array<string>")), F.col("_names")), F.array(plain_model(nfkc("canonical_model"))))
    return out.select("product_id", "manufacturer_id", "canonical_model", F.array_sort(names).alias("aliases"))
