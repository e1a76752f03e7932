"""Mixing sources to target weights: hierarchical budgeting over domain, language and source, with Spark expressions only.

A budget of tokens goes down a tree. At each node it is dealt to the children by weight; a child that can't use its part
(its documents, over all epochs, are too few) keeps what it can use, and its siblings share the rest, so a shortage is
made good as low in the tree as possible. A leaf then takes whole epochs and a prefix of one more, in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SEED, EPOCHS = "mix-1", 2
#: Target weights, whole numbers; what isn't listed weighs DEFAULT. Domains are derived from the source's name.
DOMAINS = 3
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "es": 2, "fr": 2}
DEFAULT = 1
#: Leaves up to which the leaf table (under 1 KB a row) may be broadcast; beyond it the join is shuffled.
LEAVES = 20_000
#: Hex digits of a document's order key that name its bin: 16^3 bins, so that no window ever holds a whole leaf.
BIN_DIGITS = 3


def source_domain() -> Column:
    number = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit("d"), F.pmod(number, F.lit(DOMAINS)).cast("string"))


def text_tokens() -> Column:
    """Tokens as four bytes each, rounded up: the size of a text without splitting it."""
    return F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")


def weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT)
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def deal(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water level: budget b of a parent over children with weight w and capacity c (whole numbers), column got.

    By rising c / w, a child is filled while its capacity lies under the level (b - filled) / (weight left); the rest get
    floor(level * w). Equal ratios go by name.
    """
    rising = Window.partitionBy(*parent).orderBy((F.col("c") / F.col("w")), child)
    before, total = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    zero = lambda c: F.coalesce(c, F.lit(0))
    level = (F.col("b") - zero(F.sum("c").over(before))) / (F.sum("w").over(total) - zero(F.sum("w").over(before)))
    nodes = nodes.withColumns({"at": F.row_number().over(rising), "level": level})
    # the first child that its capacity doesn't limit sets the level for itself and all after it
    free = F.when(F.col("c") > F.floor(F.col("level") * F.col("w")), F.struct("at", "level"))
    nodes = nodes.withColumn("free", F.min(free).over(total))
    got = F.when(F.col("free").isNull() | (F.col("at") < F.col("free.at")), F.col("c")).otherwise(F.least("c", F.floor(F.col("free.level") * F.col("w"))))
    return nodes.withColumn("got", got.cast("long")).drop("at", "level", "free")


def budgets(leaves: DataFrame, total: Column | int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """leaves: (domain, lang, source, tokens). Adds got: the tokens each leaf is to give. total: all tokens if None.

    The tree is dealt from the root; each level's budgets are what the level above got.
    """
    at = leaves.withColumn("c", F.col("tokens") * epochs)
    languages = at.groupBy("domain", "lang").agg(F.sum("c").alias("c"))
    domains = languages.groupBy("domain").agg(F.sum("c").alias("c"))
    if total is None:
        root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("b"))
    else:
        root = leaves.agg(F.lit(total).cast("long").alias("b"))
    top = domains.withColumns({"w": weight("domain", DOMAIN_WEIGHTS), "_": F.lit(0)}).join(root.withColumn("_", F.lit(0)), "_")  # one row
    top = deal(top, ["_"], "domain").select("domain", F.col("got").alias("b"))
    mid = languages.join(top, "domain").withColumn("w", weight("lang", LANGUAGE_WEIGHTS))
    mid = deal(mid, ["domain"], "lang").select("domain", "lang", F.col("got").alias("b"))
    low = at.join(mid, ["domain", "lang"]).withColumn("w", F.lit(DEFAULT).cast("long"))
    return deal(low, ["domain", "lang"], "source").drop("b", "c", "w")


def mix(docs: DataFrame, total: int | None = None, epochs: int = EPOCHS, seed: str = SEED, domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with _domain, _epoch and _tokens: each row as often as its leaf's budget asks, 0 to `epochs` times.

    Epoch e orders a leaf's rows by md5(seed, e, doc_id); a row is taken while the tokens before it are below what the
    budget leaves for that epoch. A null lang or source is a leaf of its own, named ''. A null text has 0 tokens and goes
    with its place in the order. Other columns are carried along, whatever their names; columns _domain, _epoch and
    _tokens of docs are replaced. Rows that share a doc_id share a place and are taken together. An empty table gives no
    rows; a leaf without tokens gives only rows whose place comes before its (empty) budget is used up: none.
    """
    docs = docs.drop("_domain", "_epoch", "_tokens")
    # the columns of docs stand in one struct, so that no name of theirs meets one from here
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", F.coalesce(source_domain() if domain is None else domain, F.lit("")).alias("_domain"),
        F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), (text_tokens() if tokens is None else tokens).alias("_tokens"),
    )
    leaf = ["_domain", "_lang", "_source"]
    key = lambda e: F.md5(F.concat_ws(":", F.lit(seed), e.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    each = F.explode(F.sequence(F.lit(1), F.lit(epochs)))
    light = keyed.select(*leaf, "_tokens", "doc_id").withColumn("_epoch", each).withColumn("_key", key(F.col("_epoch")))
    # per leaf, epoch and bin of keys: summed before any shuffle, and no more rows than leaves x epochs x bins
    bins = light.groupBy(*leaf, "_epoch", F.substring("_key", 1, BIN_DIGITS).alias("_bin")).agg(F.sum("_tokens").alias("t"))
    bins = materialize(bins, "bins")
    leaves = bins.where("_epoch = 1").groupBy(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(F.sum("t").alias("tokens"))
    got = budgets(leaves, total, epochs).select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "tokens", "got")
    got = materialize(got, "budgets")
    run = Window.partitionBy(*leaf, "_epoch").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("got") - F.col("tokens") * (F.col("_epoch") - 1)  # what the budget leaves for this epoch
    at = bins.join(got, leaf).withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).withColumn("left", left)
    at = at.where("left > 0")
    # the bin in which the epoch's budget ends (its last bin if it doesn't), and the tokens left for that bin
    edge = at.where("before < left").groupBy(*leaf, "_epoch").agg(F.max(F.struct("_bin", (F.col("left") - F.col("before")).alias("room"))).alias("edge"))
    edge = materialize(edge.select(*leaf, "_epoch", "edge.*"), "edges")
    small = edge.count() <= LEAVES * epochs
    edge_side = F.broadcast(edge) if small else edge
    inside = light.join(edge_side, [*leaf, "_epoch"]).where(F.substring("_key", 1, BIN_DIGITS) == F.col("_bin"))
    inside = inside.groupBy(*leaf, "_epoch", "room", "_key").agg(F.sum("_tokens").alias("t"))  # equal ids: one place
    run = Window.partitionBy(*leaf, "_epoch").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).where("before < room")
    cut = materialize(last.groupBy(*leaf, "_epoch").agg(F.max("_key").alias("_cut")), "cuts")
    cut_side = F.broadcast(cut) if small else cut
    out = keyed.withColumn("_epoch", each).join(cut_side, [*leaf, "_epoch"]).where(key(F.col("_epoch")) <= F.col("_cut"))
    return out.select(*(F.col("_row")[c].alias(c) for c in docs.columns), "_domain", "_epoch", "_tokens")
