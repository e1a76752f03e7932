"""Product identity: exact, alias, veto and fuzzy evidence as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import identity_model, model_stem, model_variant
from tidemark.sources.shared import new_folder, written


def unambiguous(keys: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that one value claims, with it; keys that several claim are left out."""
    return keys.groupBy(*key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def similar(left: DataFrame, right: DataFrame, group: str, a: str, b: str, most: int = 1, least_length: int = 8) -> DataFrame:
    """Pairs of one group whose texts are within `most` edits, both at least `least_length` long and not equal.

    They meet by equality of what is left without one character, or of that and the whole other text: texts within one edit
    share such a rest, and names that differ in a number only don't all share one, as they would share a half.

    Each row becomes as many as its text has characters, which Spark doesn't foresee: neither side may be broadcast by the size
    of its table. A text that many rows have is exploded once; its rows are found by the whole text afterwards.
    """
    def rests(df: DataFrame, c: str) -> DataFrame:
        without = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))
        keys = F.transform(F.array_append(without, F.col(c)), lambda x: F.xxhash64(x))
        texts = df.where(F.length(c) >= least_length).select(group, c).distinct()
        return texts.withColumn("_key", F.explode(F.array_distinct(keys)))

    if most != 1:
        raise ValueError("one edit is the threshold that one character less suffices for")
    pairs = rests(left, a).join(rests(right, b).hint("merge"), [group, "_key"]).drop("_key")
    pairs = pairs.where((F.col(a) != F.col(b)) & (F.levenshtein(a, b, most) >= 0)).distinct()
    for df, c in ((left, a), (right, b)):
        if set(df.columns) != {group, c}:
            pairs = pairs.join(df.distinct(), [group, c])
    return pairs


def resolve(listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(listing_id, status, method, catalog_product_id, candidate_id) by priority: missing, unresolved model, exact, alias,
    vetoed (same stem, other variant), fuzzy (only ever a suggestion), none.

    listings: listing_id, manufacturer_id, model, model_status. catalog: product_id, manufacturer_id, canonical_model, aliases.
    """
    rows = listings.withColumn("_m", identity_model(F.coalesce("model", F.lit(""))))
    key = ["manufacturer_id", "_m"]
    names = catalog.select("product_id", "manufacturer_id", F.explode(F.concat(F.array(F.struct(F.lit("exact").alias("kind"), F.col("canonical_model").alias("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(F.lit("alias").alias("kind"), x.alias("name"))))).alias("k"))
    names = names.select("product_id", "manufacturer_id", "k.kind", identity_model(F.col("k.name")).alias("_m")).where("_m <> ''").distinct()
    # a name is resolved once, however many listings have it, and written, as several tiers read it; each sees only what those before have left open
    claimed = names.groupBy(*key).agg(*(f(F.when(F.col("kind") == k, F.col("product_id"))).alias(f"{k}_{n}") for k in ("exact", "alias") for n, f in (("n", F.count_distinct), ("id", F.min))))
    asked = rows.where(~F.col("model_status").eqNullSafe("unresolved") & (F.coalesce("manufacturer_id", F.lit("")) != "") & (F.col("_m") != "")).select(*key).distinct()
    asked = written(asked.join(claimed, key, "left"), new_folder(listings.sparkSession, "names"))
    open_ = asked.where("exact_n IS NULL").select(*key)
    exact = names.where("kind = 'exact'")
    stems = exact.select("product_id", "manufacturer_id", model_stem(F.col("_m")).alias("_stem"), model_variant(F.col("_m")).alias("_var"))
    own = open_.withColumns({"_stem": model_stem(F.col("_m")), "_v": model_variant(F.col("_m"))})
    veto = own.join(stems, ["manufacturer_id", "_stem"]).where("_v <> _var").groupBy(*key).agg(F.min("product_id").alias("veto_id"))
    near = similar(open_.join(veto, key, "left_anti"), exact.select("product_id", "manufacturer_id", F.col("_m").alias("_n")), "manufacturer_id", "_m", "_n")
    near = near.groupBy(*key).agg(F.count_distinct("product_id").alias("fuzzy_n"), F.min("product_id").alias("fuzzy_id"))
    all_ = rows.join(asked.join(veto, key, "left").join(near, key, "left"), key, "left")
    cases = [
        ((F.coalesce("manufacturer_id", F.lit("")) == "") | (F.col("_m") == ""), "unresolved", "missing_fields", None, None),
        (F.coalesce("model_status", F.lit("")) == "unresolved", "unresolved", "unresolved_model", None, None),
        (F.col("exact_n") == 1, "matched", "manufacturer_model_exact", "exact_id", None),
        (F.col("exact_n") > 1, "ambiguous", "exact_ambiguous", None, "exact_id"),
        (F.col("alias_n") == 1, "matched", "manufacturer_alias", "alias_id", None),
        (F.col("alias_n") > 1, "ambiguous", "alias_ambiguous", None, "alias_id"),
        (F.col("veto_id").isNotNull(), "unresolved", "vetoed", None, "veto_id"),
        (F.col("fuzzy_n") == 1, "unresolved", "fuzzy_candidate", None, "fuzzy_id"),
        (F.col("fuzzy_n") > 1, "unresolved", "fuzzy_ambiguous", None, "fuzzy_id"),
    ]
    out = {"status": F.lit("unresolved"), "method": F.lit("none"), "catalog_product_id": F.lit(None).cast("long"), "candidate_id": F.lit(None).cast("long")}
    for when, *values in reversed(cases):
        for name, v in zip(out, values):
            value = F.lit(v) if name in ("status", "method") else (F.col(v) if v else F.lit(None).cast("long"))
            out[name] = F.when(when, value).otherwise(out[name])
    return all_.select("listing_id", *(c.alias(n) for n, c in out.items()))
