import datetime as dt
import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.sources import evidence
from tidemark.sources.shared import new_folder
from tidemark.streaming import evidence as stream

SCHEMA = "event_id string, shop_key string, reason string, html string, captured_at timestamp"
AT = dt.datetime(2026, 3, 1, 22)
LIMITS = evidence.Limits(object_bytes=40, day_objects=12, day_bytes=200, shop_day_objects=5, burst_minutes=15, burst_objects=2, sample=3)


def made(seed, n, prefix=""):
    rng = random.Random(seed)
    at, out = AT + dt.timedelta(hours=rng.random()), []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 2, 9, 30, 120]))
        reason = rng.choice(["parser_failure", "parser_failure", "unknown_category", "no such"])
        out.append((f"{prefix}{i:04d}", rng.choice(["a", "a", "a", "b", "c", None]), reason, rng.choice(["", None, "x" * rng.randrange(1, 60), "page"]), at))
    return out


def brute(rows, limits, kept=()):
    """One object after the other, as counts stand then. kept: accepted ones of before."""
    kept, out = list(kept), {}
    for event, shop, reason, html, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if not html or reason not in evidence.REASONS:
            out[event] = ("skipped", None)
            continue
        body = html.encode()[: limits.object_bytes]
        digest = hashlib.sha256(body).hexdigest()
        until = at + dt.timedelta(days=evidence.DAYS[evidence.REASONS[reason]])
        today = [k for k in kept if k[4].date() == at.date()]
        burst = [k for k in kept if k[1] == shop and k[2] == reason and at - dt.timedelta(minutes=limits.burst_minutes) <= k[4] <= at]
        if any(k[1] == shop and k[2] == reason and k[3] == digest and k[5] > at for k in kept):
            out[event] = ("deduplicated", None)
        elif len(today) >= limits.day_objects:
            out[event] = ("suppressed", "daily_object_cap")
        elif sum(k[6] for k in today) + len(body) > limits.day_bytes:
            out[event] = ("suppressed", "daily_byte_cap")
        elif sum(k[1] == shop for k in today) >= limits.shop_day_objects:
            out[event] = ("suppressed", "shop_daily_object_cap")
        elif len(burst) >= limits.burst_objects and int(digest[:8], 16) % limits.sample:
            out[event] = ("suppressed", "burst_sampled")
        else:
            out[event] = ("archived", None)
            kept.append((event, shop, reason, digest, at, until, len(body)))
    return out, kept


@pytest.mark.parametrize("seed,limits,causes", [
    (0, LIMITS, {"daily_byte_cap", "shop_daily_object_cap"}), (1, replace(LIMITS, day_objects=4), {"daily_object_cap"}), (0, replace(LIMITS, day_objects=99, day_bytes=9999, shop_day_objects=99, burst_objects=1, sample=50), {"burst_sampled"}),
    (3, replace(LIMITS, day_bytes=2000, day_objects=99, shop_day_objects=3), {"shop_daily_object_cap"}),
])
def test_decisions_equal_brute_force(spark, seed, limits, causes):
    rows = made(seed, 250)
    want, kept = brute(rows, limits)
    got = {r.event_id: (r.status, r.why) for r in evidence.decide(spark.createDataFrame(rows, SCHEMA), limits=limits).collect()}
    assert got == want and {x for v in want.values() for x in v if x} >= {"archived", "deduplicated", "skipped"} | causes
    assert sum(s == "archived" for s, _ in got.values()) == len(kept)


def test_batches_and_replays(spark):
    """Batches one after the other accept what brute force accepts; one that comes again changes nothing."""
    store, kept, want = new_folder(spark, "store"), [], {}
    batches = [made(7, 60, "a"), [(e, s, r, h, t + dt.timedelta(hours=3)) for e, s, r, h, t in made(8, 60, "b")], made(9, 30, "c")]
    for i, rows in enumerate(batches):
        said, kept = brute(rows, LIMITS, kept)
        want |= said
        for _ in range(2):
            evidence.archive(spark.createDataFrame(rows, SCHEMA), i, store, LIMITS)
    accepted = spark.read.parquet(f"{store}/accepted").collect()
    assert sorted(r.event_id for r in accepted) == sorted(k[0] for k in kept) == sorted(e for e, (s, _) in want.items() if s == "archived")
    bodies = spark.read.parquet(f"{store}/objects").collect()
    assert all(hashlib.sha256(bytes(b.body)).hexdigest() == b.content_hash == b.object_key.rsplit("/", 1)[-1] for b in bodies)
    assert {b.object_key for b in bodies} == {r.object_key for r in accepted}
    again = evidence.decide(spark.createDataFrame(batches[0], SCHEMA), spark.read.parquet(f"{store}/accepted"), LIMITS)
    assert {r.event_id for r in again.where("status = 'archived'").collect()} == {e for e, (s, _) in want.items() if s == "archived" and e.startswith("a")}


def test_stream(spark):
    rows = made(11, 80)
    source, store = new_folder(spark, "source"), new_folder(spark, "store")
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = stream.run(spark.readStream.schema(SCHEMA).parquet(source), store, f"{store}-checkpoint", LIMITS)
        query.awaitTermination()
        assert query.exception() is None
    assert sorted(r.event_id for r in spark.read.parquet(f"{store}/accepted").collect()) == sorted(k[0] for k in brute(rows, LIMITS)[1])


def test_secrets_go_before_hashing(spark):
    texts = {
        '<input type="hidden" name="csrf" value="abc"><input name="q" value="abc">': '<input type="hidden" name="csrf" value="[REDACTED]"><input name="q" value="abc">',
        "<META name='auth-token' content='x>y'>": None, "<meta name='session' content='s1'>": '<meta name=\'session\' content="[REDACTED]">',
        "{\"access_token\": \"t'1\", 'password' : 'p', \"other\": \"o\"}": "{\"access_token\": \"[REDACTED]\", 'password' : '[REDACTED]', \"other\": \"o\"}", "cookie=\"c\" Cookie='d'": "cookie=\"[REDACTED]\" Cookie='[REDACTED]'", "plain": "plain",
    }
    rows = spark.createDataFrame([(k,) for k in texts], "html string").select("html", evidence.redacted(F.col("html")).alias("r"))
    assert all(texts[r.html] in (None, r.r) for r in rows.collect())
    secret = [(str(i), "Shop 1/Ｘ", "parser_failure", f'<input name="token" value="{i}">', AT) for i in range(3)]
    got = evidence.decide(spark.createDataFrame(secret, SCHEMA)).orderBy("event_id").collect()
    assert [r.status for r in got] == ["archived", "deduplicated", "deduplicated"]
    assert got[0].object_key.startswith("evidence/short/shop-1-x/2026/03/01/") and (got[0].expires_at - AT).days == 30


def test_odd_objects(spark):
    rows = [(None, "a", "parser_failure", "x", AT), ("1", "a", "parser_failure", "y", None), ("2", None, "parser_failure", "é" * 30, AT), ("2", None, "parser_failure", "é" * 30, AT)]
    got = evidence.decide(spark.createDataFrame(rows, SCHEMA), limits=LIMITS).collect()
    assert sorted((str(r.event_id), r.status) for r in got) == [("1", "skipped"), ("2", "archived"), ("2", "archived"), ("None", "skipped")]
    assert {(r.content_bytes, r.truncated) for r in got if r.event_id == "2"} == {(40, True)}
    assert evidence.decide(spark.createDataFrame([], SCHEMA)).count() == 0
