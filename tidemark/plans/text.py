"""Search by a stored index and by product filters on the driver's tables, each query with its DuckDB SQL.

The index holds parts as entities. After it is written, some titles change and some parts go, as a second generation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import entities, search
from tidemark.operators.text_index import TextIndex
from tidemark.sources.shared import new_folder

from .listings import _t, offers
from .oracles import _ENTITIES, _OFFERS

COLUMNS = ("manufacturer_terms", "normalized_model", "model_terms", "title_terms", "category_terms")
#: Weights of the columns in the ranking (fixed values).
WEIGHTS = [8.0, 7.0, 6.0, 4.0, 1.0]


def _entities(spark, d, changed=False):
    p = _t(spark, d, "part")
    title = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    if changed:
        p = p.where("p_size > 1")
        title = F.when(F.col("p_size") >= 45, F.concat(F.lit("RING ring for "), F.lower("p_type"))).otherwise(title)
    return p.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("manufacturer_terms"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("normalized_model"),
        F.col("p_name").alias("model_terms"), title.alias("title_terms"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("category_terms"), "p_size",
    )


def _index(spark, d):
    index = TextIndex(spark, new_folder(spark, "index"), "entity_id", COLUMNS).create(_entities(spark, d))
    return index.apply(_entities(spark, d, True).where("p_size >= 45"), _entities(spark, d).where("p_size = 1").select("entity_id"))


_DOCS = """docs AS (
  SELECT p_partkey AS entity_id, p_size, [lower(p_brand), lower(replace(p_name, ' ', '')), lower(p_name),
    CASE WHEN p_size >= 45 THEN lower('RING ring for ' || p_type) ELSE lower(p_brand || ' ' || p_name || ' ' || p_type) END, CASE WHEN p_size % 3 > 0 THEN lower(p_type) ELSE '' END] AS texts
  FROM part WHERE p_size > 1
)"""


def _scored(terms: list[str]) -> str:
    """CTE scored (entity_id, score) for terms, those of under three characters only select."""
    def places(t):
        return f"list_transform(texts, lambda x: len(list_filter(range(1, length(x) - {len(t)} + 2), lambda i: substr(x, i, {len(t)}) = '{t}')))"

    weighed = lambda t: f"list_sum(list_transform(list_zip({places(t)}, {WEIGHTS}), lambda z: z[1] * z[2]))"
    long = [i for i, t in enumerate(terms) if len(t) > 2]
    cols = ", ".join(f"{weighed(t)} AS f{i}" for i, t in enumerate(terms))
    idf = lambda i: f"greatest(ln(((SELECT count(*) FROM hits) - (SELECT count(*) FROM hits WHERE f{i} > 0) + 0.5) / ((SELECT count(*) FROM hits WHERE f{i} > 0) + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * tokens / (SELECT avg(tokens) FROM hits)))" for i in long) or "0.0"
    return f"""hits AS (SELECT entity_id, {cols}, list_sum(list_transform(texts, lambda x: greatest(length(x) - 2, 0))) AS tokens FROM docs),
  scored AS (SELECT entity_id, round({score}, 6) AS score FROM hits WHERE {" AND ".join(f"f{i} > 0" for i in range(len(terms)))})"""


def stored_search(spark, d):
    """A long word that texts repeat, a brand that others begin with, and two characters."""
    return _index(spark, d).search("ring  BRAND#1 or", WEIGHTS).withColumn("score", F.round("score", 6))


def stored_short_search(spark, d):
    """Terms of one and two characters alone, over what changed too."""
    return _index(spark, d).search("#2 w o", WEIGHTS)


def index_problems(spark, d):
    """Where the index as first written differs from the rows as they are after the change."""
    index = TextIndex(spark, new_folder(spark, "index"), "entity_id", COLUMNS).create(_entities(spark, d).where("p_size < 49"))
    return index.check(_entities(spark, d, True))


def relevance_search(spark, d):
    """The first hundred for a brand and a model, by tier, score, latest activity and id."""
    e = _t(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("manufacturer_id"), F.col("p_name").alias("model"))
    seen = offers(spark, d).groupBy("entity_id").agg(F.max("last_activity_at").alias("latest_activity_at"))
    found = _index(spark, d).search("ring", WEIGHTS).withColumn("score", F.round("score", 6))
    out = search.ranked(e.join(seen, "entity_id", "left"), found, "Brand#8", "small ring").limit(100)
    return out.select("entity_id", "tier", "score")


def product_filters(spark, d):
    """Entities of a maker by id or by what shops call it, in a category with all below it, with two features, and an offer in stock."""
    p = _t(spark, d, "part")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    badge = F.element_at(F.array(F.lit("【中古】"), F.lit("[used] "), F.lit("〖新品〗"), F.lit("new ")), (F.col("p_size") % 4 + 1).cast("int"))
    category = F.element_at(F.array(*(F.lit(c) for c in ("cable_usb", "cable", "rack", "dac", "network_transport"))), (F.col("p_size") % 5 + 1).cast("int"))
    e = p.select(F.col("p_partkey").alias("entity_id"), F.when(number % 3 > 0, F.lower("p_brand")).otherwise("").alias("manufacturer_id"), F.concat(badge, F.replace("p_brand", F.lit("#"), F.lit("# "))).alias("manufacturer"), category.alias("primary_category_id"))
    o = offers(spark, d)
    said = o.select("listing_id", F.when(F.col("price_yen") % 2 == 0, "dac").otherwise("phono_input").alias("feature"), F.when(F.col("price_yen") % 3 > 0, "present").otherwise("absent").alias("state"))
    f = search.ProductFilter(("brand#7", "brand#8"), ("BRAND # 9", "brand#12"), "アクセサリー", ("dac", "phono_input"))
    out = search.same_offer(f.apply(e.join(entities.aggregate(o).select("entity_id", "offer_count"), "entity_id"), o, said), o, search.OfferFilter(in_stock=True))
    return out.select("entity_id", "offer_count", "primary_category_id")


QUERIES = {f.__name__: f for f in (stored_search, stored_short_search, index_problems, relevance_search, product_filters)}
ORACLES = {
    "stored_search": f"WITH {_DOCS}, {_scored(['ring', 'brand#1', 'or'])} SELECT entity_id, score FROM scored",
    "stored_short_search": f"WITH {_DOCS}, {_scored(['#2', 'w', 'o'])} SELECT entity_id, score FROM scored",
    "index_problems": """SELECT p_partkey AS entity_id, CASE WHEN p_size = 1 THEN 'extra' WHEN p_size >= 49 THEN 'missing' ELSE 'differs' END AS problem
  FROM part WHERE p_size = 1 OR p_size >= 45""",
    "relevance_search": f"""WITH {_OFFERS}, {_DOCS}, {_scored(['ring'])}, seen AS (SELECT entity_id, max(seen_at) AS seen_last FROM offers GROUP BY 1)
  SELECT entity_id, CAST(CASE WHEN p_brand = 'Brand#8' AND p_name = 'small ring' THEN 0 WHEN p_name = 'small ring' THEN 1 ELSE 3 END AS INTEGER) AS tier, score
  FROM scored JOIN part ON p_partkey = entity_id LEFT JOIN seen USING (entity_id) ORDER BY tier, score DESC, seen_last DESC NULLS LAST, entity_id DESC LIMIT 100""",
    "product_filters": f"""WITH {_OFFERS}, {_ENTITIES}, p AS (
    SELECT p_partkey AS entity_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num, p_size % 4 < 3 AS badge, ['cable_usb', 'cable', 'rack', 'dac', 'network_transport'][p_size % 5 + 1] AS c FROM part
  ), f AS (SELECT entity_id FROM offers WHERE price_yen % 3 > 0 GROUP BY 1 HAVING count(DISTINCT price_yen % 2) = 2)
  SELECT entity_id, offer_count, c AS primary_category_id FROM p JOIN entities USING (entity_id) JOIN f USING (entity_id)
  WHERE ((num % 3 > 0 AND num IN (7, 8)) OR (badge AND num IN (9, 12))) AND c IN ('cable_usb', 'rack') AND in_stock_offer_count > 0""",
}
