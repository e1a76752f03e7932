"""Reads over listings and their history: pages, counts, details, top-k, due rows, checks of rows and of request parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import new_folder, written

#: Rows of a detail view, of a history at most and by default (fixed values).
DETAIL, HISTORY_MOST, HISTORY = 200, 200, 50
#: Page sizes and the largest offset of a request (fixed values).
PAGE, PAGE_MOST, OFFSET_MOST = 50, 100, 10_000


def keyset_page(df: DataFrame, key: str, after=None, upto=None, limit: int | None = None) -> DataFrame:
    """Rows beyond `after` and up to the horizon `upto`, in order of key; without a limit all of them, as one scan."""
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    if upto is not None:
        df = df.where(F.col(key) <= F.lit(upto))
    return df.orderBy(key) if limit is None else df.orderBy(key).limit(limit)


def capped_count(df: DataFrame, most: int) -> DataFrame:
    """(n, more): the count, no more than `most`, and whether there are more rows. Reads no more rows than most + 1."""
    n = F.count("*")
    return df.limit(most + 1).agg(F.least(n, F.lit(most)).alias("n"), (n > most).alias("more"))


def totals(df: DataFrame, page_size: int = PAGE) -> DataFrame:
    """(total, pages) of all matches, before any cursor."""
    size = max(1, min(page_size, PAGE_MOST))
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def json_samples(df: DataFrame, by: str, order: list[Column], fields: list[str], most: int) -> DataFrame:
    """(by, samples): the first rows of each group as a JSON array of objects. Rank limits run before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    top = df.withColumn("_n", rank).where(F.col("_n") <= most)
    rows = F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("o"))))
    return top.groupBy(by).agg(F.to_json(F.transform(rows, lambda x: x.o)).alias("samples"))


def representative_order() -> list[Column]:
    """In stock first, priced before unpriced, cheapest, latest activity, then id."""
    return [F.when(F.col("stock_status") == "in_stock", 0).otherwise(1).asc(), F.asc_nulls_last("price_yen"), F.desc_nulls_last("last_activity_at"), F.asc("listing_id")]


def detail(offers: DataFrame, entity_id, most: int = DETAIL) -> DataFrame:
    """All offers of an entity in representative order."""
    return offers.where(F.col("entity_id") == F.lit(entity_id)).orderBy(*representative_order()).limit(most)


def nth_latest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n-th row of each group (1: the latest)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") == n).drop("_n")


def history(df: DataFrame, by: str, value, at: str, tie: str, limit: int | None = None) -> DataFrame:
    """One group's rows, latest first; the limit is held between 1 and HISTORY_MOST."""
    most = HISTORY if limit is None else max(1, min(limit, HISTORY_MOST))
    return df.where(F.col(by) == F.lit(value)).orderBy(F.desc(at), F.desc(tie)).limit(most)


def with_ancestors_order(tree: DataFrame, id_col: str, parent: str, order: str) -> DataFrame:
    """tree with `path` (sibling orders from the root) and `level`; sorting by (path, id) puts a parent before its children.

    One join a level, until a level has no nodes; each is written before the next. Nodes that no root leads to (their
    parent isn't there, or they are their own ancestors) have a null path and level, so nothing is lost unsaid.
    """
    spark = tree.sparkSession
    nodes = tree.select(F.col(id_col).alias("_id"), F.col(parent).alias("_parent"), F.col(order).alias("_order"))
    path = new_folder(spark, "levels")
    level, n = written(nodes.where("_parent IS NULL").select("_id", F.array("_order").alias("path")), f"{path}/0"), 0
    found = level
    while level.limit(1).count():
        n += 1
        below = nodes.join(level.select(F.col("_id").alias("_parent"), "path"), "_parent")
        level = written(below.select("_id", F.concat("path", F.array("_order")).alias("path")), f"{path}/{n}")
        found = found.unionByName(level)
    return tree.join(found, tree[id_col] == found["_id"], "left").drop("_id").withColumn("level", F.when(F.col("path").isNotNull(), F.size("path")))


def by_either_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """left with the value of the right row that meets it by the first key of the list that any does: one equi join a key
    instead of an OR, which would compare all rows. Of several right rows the smallest value counts."""
    out = left
    for i, (a, b) in enumerate(keys):
        one = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, F.col(a) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    picked = [F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v"), F.lit(a).alias("k"))) for i, (a, _) in enumerate(keys)]
    out = out.withColumn("_p", F.coalesce(*picked))
    return out.select(*left.columns, F.col("_p.v").alias(value), F.col("_p.k").alias("met_by"))


def starts_with_any(column: str, prefixes: list[str]) -> Column:
    """Prefix match whatever the case; % and _ in a prefix are plain characters."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(column).startswith(p.lower())
    return out


def due(sources: DataFrame, now: str, every_minutes: int, limit: int) -> DataFrame:
    """Sources that are enabled and whose last attempt is so long ago; never tried ones first, then the longest waiting."""
    at = F.lit(now).cast("timestamp")
    waited = F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") <= at - F.make_interval(mins=F.lit(every_minutes)))
    return sources.where(F.col("enabled") & waited).orderBy(F.asc_nulls_first("last_attempt_at"), "source_id").limit(limit)


def to_replay(products: DataFrame) -> DataFrame:
    """Verified products that changed after they were last applied to listings."""
    return products.where("last_verified_at IS NOT NULL AND (last_remediated_at IS NULL OR last_remediated_at < last_verified_at)")


def check_rows(rows: DataFrame) -> DataFrame:
    """rows with `problems`: what keeps a seller's row from being normalised. Those with none go on, others to quarantine."""
    tests = {
        "no_id": F.coalesce(F.trim("listing_id"), F.lit("")) == "",
        "no_title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "bad_price": F.col("price_yen").isNotNull() & (F.col("price_yen") <= 0),
        "bad_url": ~F.coalesce(F.lower("url").rlike("^https?://[^/]"), F.lit(False)),
    }
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items()))))


def with_thresholds(metrics: DataFrame, defaults: DataFrame, own: DataFrame) -> DataFrame:
    """metrics (shop_key, metric, value) with warning and critical bounds, a shop's own before the common ones, and the level.

    A value at a bound has its level. The two small tables are joined by key; nothing is broadcast by force.
    """
    own = own.select("shop_key", "metric", F.col("warning").alias("_w"), F.col("critical").alias("_c"))
    out = metrics.join(defaults, "metric", "left").join(own, ["shop_key", "metric"], "left")
    out = out.withColumns({"warning": F.coalesce("_w", "warning"), "critical": F.coalesce("_c", "critical")}).drop("_w", "_c")
    level = F.when(F.col("value").isNull(), "unknown").when(F.col("value") >= F.col("critical"), "critical").when(F.col("value") >= F.col("warning"), "warning")
    return out.withColumn("level", level.otherwise("healthy"))


def request(parameters: list[tuple[str, str]], allowed: dict[str, int], numeric: set[str]) -> tuple[dict[str, object], str | None]:
    """(values, None), or ({}, code) for parameters that are unknown, repeated, too long (allowed: most characters) or not
    numbers. limit and offset are held within their bounds."""
    values: dict[str, object] = {}
    for name, value in parameters:
        if name not in allowed:
            return {}, "unknown_parameter"
        if name in values:
            return {}, "repeated_parameter"
        if len(value) > allowed[name]:
            return {}, "parameter_too_long"
        if name in numeric:
            if not value.isascii() or not value.isdigit():
                return {}, "not_a_number"
            values[name] = int(value)
        else:
            values[name] = value
    values["limit"] = max(1, min(int(values.get("limit", PAGE)), PAGE_MOST))
    values["offset"] = min(int(values.get("offset", 0)), OFFSET_MOST)
    return values, None
