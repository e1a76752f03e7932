"""Entity search: conditions that must hold on one offer, sorts with a total order, cursors, facets, text."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OfferFilter:
    shop: str | None = None
    in_stock: bool = False
    price_dropped: bool = False
    min_price: int | None = None
    max_price: int | None = None
    new_since: str | None = None

    def condition(self) -> Column | None:
        """All that is asked of one and the same offer; None if nothing is."""
        parts = []
        if self.shop is not None:
            parts.append(F.col("shop_key") == self.shop)
        if self.in_stock:
            parts.append(F.col("stock_status") == "in_stock")
        if self.price_dropped:
            parts.append(F.col("price_yen").isNotNull() & F.col("previous_price_yen").isNotNull() & (F.col("price_yen") < F.col("previous_price_yen")))
        if self.min_price is not None:
            parts.append(F.col("price_yen") >= self.min_price)
        if self.max_price is not None:
            parts.append(F.col("price_yen") <= self.max_price)
        if self.new_since is not None:
            parts.append(F.coalesce("source_published_at", "first_seen_at") >= F.lit(self.new_since).cast("timestamp"))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def same_offer(entities: DataFrame, offers: DataFrame, f: OfferFilter) -> DataFrame:
    """Entities with at least one offer that meets every condition of f."""
    c = f.condition()
    return entities if c is None else entities.join(offers.where(c).select("entity_id"), "entity_id", "left_semi")


def representative(offers: DataFrame) -> DataFrame:
    """One offer an entity: in stock before not, priced before unpriced, cheapest, latest, smallest id."""
    order = Window.partitionBy("entity_id").orderBy(
        F.when(F.col("stock_status") == "in_stock", 0).otherwise(1), F.col("price_yen").isNull(), F.col("price_yen"), F.desc_nulls_last("last_activity_at"), "listing_id"
    )
    return offers.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Sort key -> (column, descending).
SORTS = {
    "newest": ("newest_listed_at", True),
    "oldest": ("newest_listed_at", False),
    "updated": ("latest_activity_at", True),
    "priceAsc": ("lowest_price_yen", False),
    "priceDesc": ("lowest_price_yen", True),
}


def order_by(sort: str) -> list[Column]:
    """Nulls last in both directions; ties by entity_id in the sort's direction."""
    c, down = SORTS[sort]
    return [F.desc_nulls_last(c), F.desc("entity_id")] if down else [F.asc_nulls_last(c), F.asc("entity_id")]


def after(sort: str, value, entity_id: int) -> Column:
    """What comes after the entity of this sort value and id; the tail of nulls included."""
    name, down = SORTS[sort]
    c, i = F.col(name), F.col("entity_id")
    beyond = (i < entity_id) if down else (i > entity_id)
    if value is None:
        return c.isNull() & beyond
    return (c < F.lit(value) if down else c > F.lit(value)) | ((c == F.lit(value)) & beyond) | c.isNull()


def encode_cursor(sort: str, value, entity_id: int) -> str:
    raw = json.dumps({"s": sort, "v": value, "i": entity_id}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(text: str | None, sort: str):
    """(value, entity_id), or None for a cursor that is malformed or was made for another sort."""
    try:
        raw = json.loads(base64.urlsafe_b64decode((text or "") + "=" * (-len(text or "") % 4)))
        return (raw["v"], int(raw["i"])) if raw["s"] == sort else None
    except (ValueError, KeyError, TypeError):
        return None


def page(entities: DataFrame, sort: str, limit: int, offset: int = 0, cursor: str | None = None) -> DataFrame:
    """One more row than the limit, so that the caller sees whether there are more."""
    at = decode_cursor(cursor, sort)
    if at:
        entities = entities.where(after(sort, *at))
    out = entities.orderBy(*order_by(sort))
    return (out.offset(min(offset, 10_000)) if offset and not at else out).limit(min(limit, 100) + 1)


def plan_terms(query: str) -> list[str]:
    """At most twelve terms, folded; all of them must be met."""
    import unicodedata

    return unicodedata.normalize("NFKC", query).lower().split()[:12]


def matches(columns: list[str], terms: list[str]) -> Column:
    """Every term stands in at least one of the columns, whatever the case."""
    out = F.lit(True)
    for t in terms:
        some = F.lit(False)
        for c in columns:
            some = some | F.lower(F.coalesce(c, F.lit(""))).contains(t)
        out = out & some
    return out


def bm25(docs: DataFrame, id_col: str, weights: dict[str, float], terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that hold a term; occurrences by column and weight, lengths over all columns.

    Statistics are one aggregate over all rows, so the table is read twice and never shuffled whole.
    """
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in weights]
    length = sum((F.size(F.split(c, r"\s+")) for c in low), F.lit(0))
    hits = {t: sum((w * (F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t) for c, w in zip(low, weights.values())), F.lit(0.0)) for t in terms}
    rows = docs.select(id_col, length.alias("_len"), *(h.alias(f"_t{i}") for i, h in enumerate(hits.values())))
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    rows = rows.withColumn("_k", F.lit(0)).join(F.broadcast(stats.withColumn("_k", F.lit(0))), "_k")  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"_t{i}")
        idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    any_hit = F.greatest(*(F.col(f"_t{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    return rows.where(any_hit).select(id_col, score.alias("score"))


def trigrams(docs: DataFrame, id_col: str, column: str) -> DataFrame:
    """(gram, id): distinct lower-case trigrams, the index behind substring search."""
    low = F.lower(F.coalesce(column, F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substr(low, i, F.lit(3)))
    return docs.select(F.explode(F.array_distinct(grams)).alias("gram"), id_col).where(F.length("gram") == 3)


def relevance(manufacturer_id: str, model: str) -> Column:
    """Tier of an entity for a query: maker and model (0), model (1), model whatever the case (2), else 3."""
    same = F.col("model") == F.lit(model)
    return F.when((F.col("manufacturer_id") == F.lit(manufacturer_id)) & same, 0).when(same, 1).when(F.lower("model") == F.lower(F.lit(model)), 2).otherwise(3)


def ranked(entities: DataFrame, found: DataFrame, manufacturer_id: str, model: str) -> DataFrame:
    """Entities that a text search found (entity_id, score), best first: by tier, then score, then latest activity, then id."""
    out = entities.join(found, "entity_id").withColumn("tier", relevance(manufacturer_id, model))
    return out.orderBy("tier", F.desc("score"), F.desc_nulls_last("latest_activity_at"), F.desc("entity_id"))


@dataclass(frozen=True)
class ProductFilter:
    """What is asked of the product itself, whatever its offers. category is a label or an id, and accepts what lies below it."""

    manufacturer_ids: tuple[str, ...] = ()
    presentations: tuple[str, ...] = ()
    category: str | None = None
    features: tuple[str, ...] = ()

    def _manufacturer(self) -> Column:
        """A maker by id, or by what shops call it: the name alone, or behind a badge in brackets."""
        plain = F.regexp_replace(F.lower(F.coalesce("manufacturer", F.lit(""))), r"(?U)\s+", "")
        out = F.col("manufacturer_id").isin(*self.manufacturer_ids) if self.manufacturer_ids else F.lit(False)
        for name in ("".join(p.lower().split()) for p in self.presentations):
            out = out | (plain == name) | (plain.rlike(r"^(【.*】|〖.*〗|\[.*\])") & plain.endswith(name))
        return out

    def apply(self, entities: DataFrame, offers: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
        """entities: manufacturer_id, manufacturer, primary_category_id. offers: entity_id, listing_id. facts: listing_id, feature, state."""
        from tidemark.operators.categories import filter_ids

        out = entities
        if self.manufacturer_ids or self.presentations:
            out = out.where(self._manufacturer())
        if self.category is not None:
            out = out.where(F.col("primary_category_id").isin(filter_ids(self.category) or [self.category]))
        if self.features:
            wanted = sorted(set(self.features))
            shown = facts.where(F.col("feature").isin(wanted) & (F.col("state") == "present")).select("listing_id", "feature")
            shown = shown.join(offers.select("listing_id", "entity_id"), "listing_id").groupBy("entity_id").agg(F.count_distinct("feature").alias("n"))
            out = out.join(shown.where(F.col("n") == len(wanted)), "entity_id", "left_semi")
        return out


def facet(entities: DataFrame, key: str, name: str) -> DataFrame:
    """One row a key: its smallest name and the number of distinct entities."""
    return entities.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias("name"), F.count_distinct("entity_id").alias("entities"))
