"""Archive of page evidence: what may be kept, without secrets, bounded, under quotas of what was accepted, each content once.

Whether an object is accepted depends on those accepted before it, over all shops, so a day is scanned in the order of time; its
state holds accepted objects only, as many as a day's cap. Days are scanned side by side. What reaches from one into
another, contents that are still kept and the last minutes before midnight, comes from the scans of the round before; rounds
end when they accept the same. A day depends on earlier ones only, so every round settles at least one day more, and most at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import nfkc
from tidemark.sources.shared import exists, new_folder, remove, written

# Days to keep, by class; classes by reason; what names a secret; what stands in its place.
DAYS = {"short": 30, "medium": 90, "long": 365}
REASONS = {
    "parser_failure": "short", "temporary_debug_snapshot": "short", "unexpected_item_count": "medium", "crawl_validation_failure": "medium", "unknown_manufacturer": "medium", "unknown_category": "medium",
    "html_structure_change": "medium", "product_content_changed": "medium", "classification_unresolved": "long", "knowledge_catalog_verification": "long",
}
SECRET_TAGS = "token|secret|password|passwd|session|cookie|authorization|auth|csrf|xsrf"
SECRET_KEYS = r"access[_-]?token|refresh[_-]?token|auth(?:orization)?|session|cookie|csrf|xsrf|password"
GONE = "[REDACTED]"


@dataclass(frozen=True)
class Limits:
    """Bytes of an object; objects and bytes of a day; objects of a shop's day; objects of a shop and reason within minutes, beyond which one in `sample` is kept."""

    object_bytes: int = 1_500_000
    day_objects: int = 500
    day_bytes: int = 200_000_000
    shop_day_objects: int = 100
    burst_minutes: int = 15
    burst_objects: int = 20
    sample: int = 10


def redacted(html: Column) -> Column:
    """html without the values of inputs and metas that speak of secrets, and of keys that name them."""
    for name in ("value", "content"):
        tag = rf"(?i)(<(?:input|meta)\b(?=[^>]*(?:{SECRET_TAGS}))[^>]*?\s{name}\s*=\s*)([\"'])[^>]*?\2"
        html = F.regexp_replace(html, tag, f'$1"{GONE}"')
    return F.regexp_replace(html, rf"(?i)([\"']?(?:{SECRET_KEYS})[\"']?\s*[:=]\s*)([\"'])(?!\[REDACTED\]).*?\2", rf"$1$2{GONE}$2".replace("[", r"\[").replace("]", r"\]"))


def segment(c: Column, otherwise: str = "unknown") -> Column:
    """A part of an object's key: lower-case letters, digits, _ and -, at most 80."""
    plain = F.btrim(F.regexp_replace(F.lower(nfkc(F.coalesce(c.cast("string"), F.lit("")))), "[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(plain, 1, 80), F.lit("")), F.lit(otherwise))


def prepared(objects: DataFrame, limits: Limits) -> DataFrame:
    """objects (event_id, shop_key, reason, html, captured_at) with retention_class (null: not to be archived), body, content_hash,
    content_bytes, truncated, object_key, expires_at. Keys come from the content, so writing an object again changes nothing."""
    c = F.col
    kind = F.coalesce(*(F.when(c("reason") == r, k) for r, k in REASONS.items()))
    raw = F.encode(redacted(c("html")), "UTF-8")
    out = objects.withColumn("retention_class", F.when(F.coalesce("html", F.lit("")) != "", kind)).withColumn("_raw", F.when(c("retention_class").isNotNull(), raw))
    out = out.withColumns({"body": F.substring("_raw", 1, limits.object_bytes), "truncated": F.octet_length("_raw") > limits.object_bytes}).drop("_raw")
    out = out.withColumns({"content_hash": F.sha2("body", 256), "content_bytes": F.octet_length("body").cast("long")})
    days = F.coalesce(*(F.when(c("retention_class") == k, n) for k, n in DAYS.items()))
    key = F.concat_ws("/", F.lit("evidence"), "retention_class", segment(c("shop_key")), F.date_format("captured_at", "yyyy/MM/dd"), "content_hash")
    return out.withColumns({"object_key": F.when(c("retention_class").isNotNull(), key), "expires_at": F.timestamp_seconds(F.unix_micros("captured_at") / 1e6 + days * 86400)})


_DAY = 86_400_000_000
_SCANNED = ["day", "kind", "shop_key", "reason", "event_id", "content_hash", "t", "bytes", "again"]
#: Rows of a scan, in their order: minutes of the day before, what was accepted in earlier runs, what is to be decided.
_BEFORE, _KEPT, _NEW = 0, 1, 2


def _scan(limits: Limits):
    """What becomes of each new object of a task's days, which come sorted: archived, again, or the first cap that it meets."""

    def decided(batches):
        at, window = None, limits.burst_minutes * 60_000_000
        for b in batches:
            for day, kind, shop, reason, event, digest, t, size, again in zip(*(b.column(c).to_pylist() for c in _SCANNED)):
                if day != at:
                    at, objects, total = day, 0, 0
                    live, shops, times = set(), defaultdict(int), defaultdict(list)
                near = times[shop, reason]
                said = "archived"
                if kind == _NEW:
                    if again or (shop, reason, digest) in live:
                        said = "again"
                    elif objects >= limits.day_objects:
                        said = "daily_object_cap"
                    elif total + size > limits.day_bytes:
                        said = "daily_byte_cap"
                    elif shops[shop] >= limits.shop_day_objects:
                        said = "shop_daily_object_cap"
                    elif limits.sample > 1 and bisect_right(near, t) - bisect_left(near, t - window) >= limits.burst_objects and int(digest[:8], 16) % limits.sample:
                        said = "burst_sampled"
                    yield event, said
                if said == "archived":
                    insort(near, t)
                    if kind != _BEFORE:
                        objects, total = objects + 1, total + size
                        shops[shop] += 1
                        live.add((shop, reason, digest))

    def run(batches):
        out = []
        for row in decided(batches):
            out.append(row)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["event_id", "said"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["event_id", "said"])

    return run


def decide(objects: DataFrame, archived: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """prepared(objects) with status and why. archived: what was accepted before, (event_id, shop_key, reason, content_hash, content_bytes, captured_at, expires_at).

    status: archived; deduplicated (the same content of shop and reason is still kept); suppressed, by the first cap that is met of the
    day's objects, its bytes, the shop's day, bursts; skipped (not to be archived, no time, or no id). Objects go by time, then id; caps count accepted
    objects only, those of archived first. An event that is archived already stays archived and counts once; of rows that repeat an event_id one is decided.
    """
    c, spark = F.col, objects.sparkSession
    path = new_folder(spark, "evidence")
    made = prepared(objects, limits)
    meta = made.where("retention_class IS NOT NULL AND captured_at IS NOT NULL AND event_id IS NOT NULL")
    facts = ["event_id", "shop_key", "reason", "content_hash", "content_bytes", "captured_at", "expires_at"]
    if archived is None:
        archived = spark.createDataFrame([], meta.select(*facts).schema)
    new = meta.join(archived.select("event_id"), "event_id", "left_anti").select(*facts).dropDuplicates(["event_id"])
    both = archived.select(*facts).withColumn("kind", F.lit(_KEPT)).unionByName(new.withColumn("kind", F.lit(_NEW)))
    micros = lambda n: F.unix_micros(c(n).cast("timestamp"))
    rows = both.select(
        F.coalesce(c("shop_key"), F.lit("")).alias("shop_key"), "reason", c("event_id").cast("string").alias("event_id"), "content_hash", micros("captured_at").alias("t"),
        F.coalesce(micros("expires_at"), F.lit(2**62)).alias("until"), c("content_bytes").alias("bytes"), "kind",
    ).withColumn("day", F.floor(c("t") / _DAY))
    rows = written(rows, f"{path}/rows")
    key = ["shop_key", "reason", "content_hash"]
    accepted, before, n = rows.where(c("kind") == _KEPT), None, 0
    while True:
        kept = accepted.select(*key, c("day").alias("_day"), c("until").alias("_until"), c("kind").alias("_kind"))
        other = rows.where(c("kind") == _NEW).join(kept, key).where((c("_day") != c("day")) & (c("_until") > c("t")) & ((c("_kind") == _KEPT) | (c("_day") < c("day"))))
        again = other.select("event_id", F.lit(True).alias("again")).distinct()
        late = accepted.where(c("t") >= (c("day") + 1) * _DAY - limits.burst_minutes * 60_000_000).withColumns({"kind": F.lit(_BEFORE), "day": c("day") + 1})
        scanned = rows.join(again, "event_id", "left").unionByName(late.withColumn("again", F.lit(None).cast("boolean"))).select(*_SCANNED)
        scanned = scanned.repartition("day").sortWithinPartitions("day", "kind", "t", "event_id")
        said = written(scanned.mapInArrow(_scan(limits), "event_id string, said string"), f"{path}/said-{n}")
        yes = said.where("said = 'archived'").select("event_id")
        now = tuple(yes.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("event_id")), F.lit(0))).first())
        if now == before:
            break
        accepted = rows.where(c("kind") == _KEPT).unionByName(rows.where(c("kind") == _NEW).join(yes, "event_id", "left_semi"))
        before, n = now, n + 1
    was = archived.select(c("event_id").cast("string").alias("_event"), F.lit(True).alias("_was")).dropDuplicates(["_event"])
    out = made.withColumn("_event", c("event_id").cast("string")).join(said.withColumnRenamed("event_id", "_event"), "_event", "left").join(was, "_event", "left")
    status = F.when(c("_was") | (c("said") == "archived"), "archived").when(c("said") == "again", "deduplicated").when(c("said").isNotNull(), "suppressed").otherwise("skipped")
    remove(spark, f"{path}/rows", *(f"{path}/said-{i}" for i in range(n)))
    return out.withColumns({"status": status, "why": F.when(status == "suppressed", c("said"))}).drop("_event", "_was", "said")


def archive(batch: DataFrame, number: int, store: str, limits: Limits = Limits()) -> None:
    """One micro-batch into the store: bodies by their keys under objects, what was accepted under accepted, both by the batch's number.

    A batch that comes again overwrites what it wrote, after deciding it against all other batches: nothing is accepted twice.
    """
    spark = batch.sparkSession
    facts = ["event_id", "shop_key", "reason", "content_hash", "content_bytes", "captured_at", "expires_at", "object_key", "truncated"]
    archived = spark.read.parquet(f"{store}/accepted").where(F.col("batch") < number).select(*facts[:7]) if exists(spark, f"{store}/accepted") else None
    decided = decide(batch, archived, limits).where("status = 'archived'")
    if archived is not None:
        decided = decided.join(archived.select("event_id"), "event_id", "left_anti")
    decided = decided.dropDuplicates(["event_id"])
    decided.select("object_key", "body", "content_hash", "retention_class").dropDuplicates(["object_key"]).write.mode("overwrite").parquet(f"{store}/objects/batch={number}")
    decided.select(*facts).write.mode("overwrite").parquet(f"{store}/accepted/batch={number}")
