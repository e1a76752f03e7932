"""N-gram Jaccard join: documents whose sets of word n-grams are nearly equal, and their connected classes.

1. Documents with one set are one: what follows sees each distinct set once.
2. Two sets that link share k of their first (1 - t) n + k n-grams in a common order, frequent n-grams last. Sets meet in
   the buckets of these n-grams; buckets with the same members are one bucket; a set with fewer than k n-grams in buckets
   links with none.
3. A bucket's members are first held against one of them, its hub. What this links is connected, and that is all a class
   needs: nothing between members of one class is looked at again.
4. Buckets that still hold several classes are searched with a signature tree: nodes hold OR-combined bitmaps of n-grams
   and ranges of sizes, and a dual traversal drops pairs of nodes whose largest possible overlap is too small.
5. Of what is left in a bucket a forest comes first, likeliest pairs before others: no more pairs than members. They are
   compared exactly, on the whole sets, and only buckets that still hold several classes give the rest of their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, releasing

#: N-grams known to be frequent, ordered last; a bound on what is sent to all tasks (9 bytes each). It never changes a
#: result, only how large buckets get. A task reports an n-gram that NOTED of its documents hold; FREQUENT in all are needed.
KNOWN, NOTED, FREQUENT = 1_000_000, 2, 4
#: Rows of one block of a bucket, n-grams counted at a time, rows of a side that may be broadcast, members of a hub's part.
BLOCK, CHUNK, SIDE, PART = 4096, 1_000_000, 400_000, 500
#: Places of a task's memory of sets it has seen, each by its fingerprint; a set that is forgotten is sketched again.
SEEN = 1 << 16
#: Bitmaps of the signature trees are this many times narrower than those that decide on pairs, as a set may stand in many buckets.
NARROWER = 4

#: What names a unit of a tree's work: a bucket, a band of sizes, and one or two of its blocks.
UNIT = ["u1", "u2", "u3", "u4"]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FAN = 4


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct n-grams of a text as 64-bit hashes. Words end at ASCII white space; A-Z count as a-z. Fewer words
    than `size` are one n-gram; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shared_grams(n: int) -> int:
    """How many of their first (1 - t) n + this n-grams two different sets that link must share, the smaller one having n.

    Different sets that link share this many at all: with 80 % or more, sets of under 5 n-grams only link if equal.
    """
    return 2 + n // 50


def bitmap(s: np.ndarray) -> bytes:
    """Eight to sixteen bits for each n-gram, a power of two, 8192 at least: short texts are told apart best."""
    width = max(8192, 1 << (8 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(b: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, narrowed to `size` bytes; n-grams keep their place modulo the width."""
    return np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)


def _signatures(sets: DataFrame) -> DataFrame:
    """(sid, bits) of sets with narrow bitmaps: two to four bits for each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            narrow = [fold(b, len(b) // NARROWER).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(narrow, pa.binary())], names=["sid", "bits"])

    return sets.select("sid", "bits").mapInArrow(releasing(run), "sid long, bits binary")


def _first_look(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (doc_id, n, fp) and rows of n-grams (gram, df) that some task found often."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def often():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            g, n = g[n >= NOTED].view(np.int64), n[n >= NOTED]
            held.clear()
            none = pa.nulls(len(g), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(n)], names=names)

        for batch in batches:
            ids, n, fp = batch.column(0), [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                fp.append(fingerprint(s))
                held.append(s)
                if sum(map(len, held[-1:])) and len(held) % 64 == 0 and sum(map(len, held)) > CHUNK:
                    yield often()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), none, none], names=names)
        if held:
            yield often()

    names = ["doc_id", "n", "fp", "gram", "df"]
    return docs.mapInArrow(releasing(run), "doc_id long, n long, fp binary, gram long, df long")


def _sketch(docs: DataFrame, size: int, percent: int, known: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(fp, n, prefix, bits, t1, t2): once for each document that has n-grams and whose set the task hasn't seen before."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: list[bytes | None] = [None] * SEEN
        for batch in batches:
            out = []
            for text, t1, t2 in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s = shingles(text.as_py(), size)
                fp = fingerprint(s)
                place = int.from_bytes(fp[:4], "little") % SEEN
                if not len(s) or seen[place] == fp:
                    continue
                seen[place] = fp
                take = len(s) - -(-percent * len(s) // 100) + shared_grams(len(s))
                at = np.searchsorted(known, s)
                often = np.zeros(len(s), np.uint64)
                if len(known):
                    at = np.minimum(at, len(known) - 1)
                    often = np.where(known[at] == s, rank[at], 0).astype(np.uint64)
                # the common order is that of numbers: rank first, then 56 bits of the hash
                first = np.sort((often << np.uint64(56)) | (s >> np.uint64(8)))[:take]
                out.append((fp, len(s), first.view(np.int64), bitmap(s), t1, t2))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["fp", "n", "prefix", "bits", "t1", "t2"])

    texts = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return texts.mapInArrow(releasing(run), "fp binary, n long, prefix array<long>, bits binary, t1 long, t2 long")


def _may_link(bits: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) with n and bits of both, those whose sizes and bitmaps leave room for the overlap needed."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for na, nb, ba, bb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                need = -(-percent * (na + nb) // (100 + percent))
                ok = need <= min(na, nb)
                if ok:
                    w = min(len(ba), len(bb))
                    ok = int(np.bitwise_count(fold(ba, w) ^ fold(bb, w)).sum()) <= na + nb - 2 * need
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return bits.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(releasing(run), "a long, b long")


def tree_pairs(n: np.ndarray, group: np.ndarray, bits: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of places that may link and differ in group, likeliest first; of two different blocks, if there are two.

    Leaves are sorted by signature, so like stands beside like; a node joins _FAN of the level below. A pair of nodes goes
    if their sizes can't be near enough, if all below is one group, or if a member of one has too many bits that the other
    node lacks: each such bit is an n-gram not shared, and a member of n may miss no more than (1 - t) n.
    """
    order = np.lexsort((n, *bits.T[:4][::-1]))
    n, group, bits, block = n[order], group[order], bits[order], block[order]
    two = len(np.unique(block)) > 1
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = [dict(lo=n, hi=n, few=ones, bits=bits, g0=group, g1=group, b0=block, b1=block)]
    while len(levels[-1]["lo"]) > 1:
        x, at = levels[-1], np.arange(0, len(levels[-1]["lo"]), _FAN)
        up = {k: f.reduceat(x[k], at, axis=0) for k, f in (("lo", np.minimum), ("hi", np.maximum), ("few", np.minimum), ("bits", np.bitwise_or), ("g0", np.minimum), ("g1", np.maximum), ("b0", np.minimum), ("b1", np.maximum))}
        levels.append(up)
    a = b = np.zeros(1, np.int64)
    room = np.zeros(0, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        x = levels[depth]
        kept_a, kept_b, kept_room = [], [], []
        for i in range(0, len(a), 65536):
            p, q = a[i : i + 65536], b[i : i + 65536]
            ok = (100 * x["hi"][p] >= percent * x["lo"][q]) & (100 * x["hi"][q] >= percent * x["lo"][p])
            ok &= ~((x["g0"][p] == x["g1"][p]) & (x["g0"][q] == x["g1"][q]) & (x["g0"][p] == x["g0"][q]))
            if two:
                ok &= ~((x["b0"][p] == x["b1"][p]) & (x["b0"][q] == x["b1"][q]) & (x["b0"][p] == x["b0"][q]))
            if depth == 0:
                ok &= p != q
            p, q = p[ok], q[ok]
            shared = np.bitwise_count(x["bits"][p] & x["bits"][q]).sum(axis=1).astype(np.int64)
            ok = (100 * (x["few"][p] - shared) <= (100 - percent) * x["hi"][p]) & (100 * (x["few"][q] - shared) <= (100 - percent) * x["hi"][q])
            if depth == 0:  # both leaves are known: what they don't share can't outnumber what an overlap large enough leaves
                need = -(-percent * (n[p] + n[q]) // (100 + percent))
                more = n[p] + n[q] - 2 * need - (ones[p] + ones[q] - 2 * shared)
                ok &= more >= 0
                kept_room.append(more[ok])
            kept_a.append(p[ok])
            kept_b.append(q[ok])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        if not depth or not len(a):
            room = np.concatenate(kept_room) if kept_room else room
            break
        width = len(levels[depth - 1]["lo"])
        da, db = (d.ravel() for d in np.meshgrid(np.arange(_FAN), np.arange(_FAN)))
        a, b = (a[:, None] * _FAN + da).ravel(), (b[:, None] * _FAN + db).ravel()
        ok = (a < width) & (b < width) & (a <= b)
        a, b = a[ok], b[ok]
    first = np.argsort(-room, kind="stable")
    return np.stack([order[a[first]], order[b[first]]]) if len(a) else np.empty((2, 0), np.int64)


def forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the pairs of places (a, b), taken in order, connect groups that those before them don't."""
    root = np.unique(group, return_inverse=True)[1]
    keep, at, step = np.zeros(len(a), bool), 0, 256
    while at < len(a):
        open_ = at + np.flatnonzero(root[a[at : at + step]] != root[b[at : at + step]])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, x, y in zip(open_.tolist(), root[a[open_]].tolist(), root[b[open_]].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                keep[i] = True
        if up:
            new = np.arange(root.max() + 1)
            new[list(up)] = [top(x) for x in up]
            root = new[root]
        at, step = at + step, min(2 * step, 65536)
    return keep


def _tree_search(members: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """members: (u1, u2, u3, u4, sid, n, comp, blk, bits), the u's naming a unit of work; units come one after another.

    Gives pairs (a, b) with their unit: all, or a forest that connects the same classes; more says whether the unit has others."""

    def unit(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        if t.num_rows < 2:
            return None
        raw = t.column("bits").to_pylist()
        width = min(map(len, raw))
        bits = np.stack([fold(b, width) for b in raw])
        sid, n, comp, blk = (t.column(c).to_numpy() for c in ("sid", "n", "comp", "blk"))
        a, b = tree_pairs(n, comp, bits, blk, percent)
        keep = np.ones(len(a), bool) if all_pairs else forest(a, b, comp)
        a, b = a[keep], b[keep]
        us = [pa.repeat(t.column(u)[0], len(a)) for u in UNIT]
        more = pa.repeat(not keep.all(), len(a))
        return pa.RecordBatch.from_arrays([*us, pa.array(np.minimum(sid[a], sid[b])), pa.array(np.maximum(sid[a], sid[b])), more], names=[*UNIT, "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                key = tuple(keys[:, i])
                if key != last and held:
                    if (out := unit(held)) is not None:
                        yield out
                    held = []
                last = key
                held.append(batch.slice(i, j - i))
        if held and (out := unit(held)) is not None:
            yield out

    members = members.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return members.mapInArrow(releasing(run), "u1 long, u2 long, u3 long, u4 long, a long, b long, more boolean")


def _connect(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (sid, comp), without those that are their class themselves, after its classes are connected by links (a, b)."""
    for s in ("a", "b"):
        of = comps.select(F.col("sid").alias(s), F.col("comp").alias(f"c{s}"))
        links = links.join(of, s, "left").withColumn(s, F.coalesce(f"c{s}", s)).drop(f"c{s}")
    joined = components(links).select(F.col("node").alias("comp"), "component")
    final = comps.join(joined, "comp", "left").select("sid", F.coalesce("component", "comp").alias("comp"))
    return final.unionByName(joined.select(F.col("comp").alias("sid"), F.col("component").alias("comp")))


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) that link, by their whole sets. Each pair's b is read beside a; a popular a stands in several parts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "t1", "t2"), "sid")
    wanted = materialize(wanted, f"{name}-wanted")
    side = F.broadcast(wanted) if wanted.count() <= SIDE else wanted
    texts = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).join(side, ["t1", "t2"])
    texts = materialize(texts.groupBy("sid").agg(F.first("text").alias("text")), f"{name}-texts")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    spokes = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("s"), F.lit(1).alias("role"), "b")
    centres = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.lit(0).alias("role"), F.col("a").alias("b"))
    rows = spokes.unionByName(centres).join(texts.withColumnRenamed("sid", "b"), "b").select("a", "s", "role", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        at, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, role, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                s = shingles(text.as_py(), size) if role or a != at else hub
                if not role:
                    at, hub = a, s
                elif linked(hub, s, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    # hash partitioning by (a, s), then sorted: a part's hub comes first
    return rows.repartition("a", "s").sortWithinPartitions("a", "s", "role").mapInArrow(releasing(run), "a long, b long")


def ngram_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: linked if 100 * |a & b| >= percent * |a | b|.

    component_id is the smallest doc_id reachable by links, itself included. A null or empty text, or one of white space
    only, has no n-grams and links with nothing. Equal texts are linked whatever their number; no pair of different texts
    is lost. A row with a null doc_id takes part in links but is never a component's name, unless all its ids are null.
    Other columns are ignored. An empty table gives no rows. percent is at least 67.
    """
    if not 67 <= percent <= 100 or size < 1:
        raise ValueError("percent must be from 67 to 100 and size positive: below, sets of few n-grams could link unseen")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    look = materialize(_first_look(docs, size), "look")
    often = look.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= FREQUENT)
    often = materialize(often.select("gram", F.floor(F.log2("df")).cast("int").alias("rank")), "often")
    room, least = KNOWN, 127
    for r in sorted(often.groupBy("rank").count().collect(), reverse=True):  # at most 63 classes
        if r["count"] > room:
            break
        room, least = room - r["count"], r["rank"]
    often = often.where(F.col("rank") >= least).toPandas()  # at most KNOWN rows
    gram = often["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    known, rank = gram[order], often["rank"].to_numpy(np.int8)[order]
    all_docs = look.where("fp IS NOT NULL").select("doc_id", "n", "fp")
    sketch = _sketch(docs, size, percent, known, rank).dropDuplicates(["fp"]).withColumn("sid", F.monotonically_increasing_id())
    sets = materialize(sketch, "sets")

    grams = sets.select(F.posexplode("prefix").alias("pos", "gram"), "sid")
    mix = F.xxhash64("sid")
    # the hub is another member in each bucket, by a hash: whoever isn't like one hub is like that of another bucket
    turn = F.struct(F.xxhash64("gram", "sid").alias("h"), "sid")
    buckets = grams.groupBy("gram").agg(F.count("*").alias("c"), F.bit_xor(mix).alias("x"), F.sum(F.shiftright(mix, 24)).alias("y"), F.min(turn).alias("hub"))
    buckets = buckets.where("c > 1").groupBy("c", "x", "y").agg(F.min(F.struct("gram", "hub.sid")).alias("b"), F.count("*").alias("m"))
    buckets = materialize(buckets.select("b.gram", F.col("b.sid").alias("hub"), "m"), "buckets")
    # a partner has at least percent % of a set's n-grams; m n-grams stand behind a bucket
    least = 2 + F.floor(F.ceil(F.col("n") * percent / 100) / 50)
    met = grams.join(buckets.hint("merge"), "gram").groupBy("sid").agg(F.sum("m").alias("met"), F.collect_list(F.struct("gram", "hub", "pos")).alias("b"))
    met = met.join(sets.select("sid", "n"), "sid").where(F.col("met") >= least)
    # one shared n-gram stands among the first (1 - t) n + 1 of both; buckets go by their earliest n-gram, so it counts here
    early = F.col("b.pos") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    members = met.select("sid", "n", F.explode("b").alias("b")).where(early).select("sid", "b.gram", "b.hub")
    members = materialize(members, "members")

    # bitmaps are joined last, to the few pairs whose sizes are near enough
    def with_bits(pairs: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("sid").alias(s), F.col("bits").alias(f"b{s}")), s)
        return _may_link(pairs, percent)

    stars = members.where("sid <> hub").select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b")).distinct()
    for s in ("a", "b"):
        stars = stars.join(sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}")), s)
    stars = stars.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    near = materialize(with_bits(materialize(stars, "stars")), "near")
    first = materialize(_verify(near, docs, sets, size, percent, "stars"), "links")

    comps = components(first).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    comps = materialize(comps, "classes")
    placed = members.join(comps, "sid", "left").select("gram", "sid", F.coalesce("comp", "sid").alias("comp"))
    mixed = placed.groupBy("gram").agg(F.min("comp").alias("g0"), F.max("comp").alias("g1")).where("g0 <> g1").select("gram")
    placed = placed.join(mixed, "gram").join(sets.select("sid", "n"), "sid")
    # sizes within the threshold differ by one band at most: a set stands in its own band and the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    units = placed.withColumn("band", F.explode(F.array(band, band + 1)))
    counts = units.groupBy("gram", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.min("comp").alias("g0"), F.max("comp").alias("g1"))
    counts = counts.where("g0 <> g1").select("gram", "band", "nb")
    units = units.join(counts, ["gram", "band"]).withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("long"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
    units = units.select(
        F.col("gram").alias("u1"), F.col("band").cast("long").alias("u2"), F.least("blk", "other").alias("u3"),
        F.greatest("blk", "other").alias("u4"), "sid", "n", "comp", "blk",
    )
    units = materialize(units, "units")

    def search(units: DataFrame, all_pairs: bool) -> DataFrame:
        return _tree_search(units.join(_signatures(sets), "sid").select(*UNIT, "sid", "n", "comp", "blk", "bits"), percent, all_pairs)

    def that_link(found: DataFrame, name: str) -> DataFrame:
        for s in ("a", "b"):
            found = found.join(sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}")), s)
        return _verify(materialize(with_bits(found), name), docs, sets, size, percent, name)

    # a group of near copies stands in many buckets and has pairs in its square: a forest of it is enough, as far as it links
    trees = materialize(search(units, False), "trees")
    comps = materialize(_connect(comps, that_link(trees.select("a", "b").distinct(), "candidates")), "joined")
    rest = units.join(trees.where("more").select(*UNIT).distinct(), UNIT).join(comps.withColumnRenamed("comp", "now"), "sid", "left")
    rest = rest.withColumn("comp", F.coalesce("now", "sid")).drop("now")
    mixed = rest.groupBy(*UNIT).agg(F.min("comp").alias("g0"), F.max("comp").alias("g1")).where("g0 <> g1").select(*UNIT)
    rest = materialize(rest.join(mixed, UNIT), "rest")
    if not rest.isEmpty():
        comps = _connect(comps, that_link(search(rest, True).select("a", "b").distinct(), "last-candidates"))
    classes = sets.select("sid", "fp").join(comps, "sid", "left").select("fp", F.coalesce("comp", "sid").alias("comp"))
    smallest = all_docs.groupBy("fp").agg(F.min("doc_id").alias("d")).join(classes, "fp")
    named = smallest.groupBy("comp").agg(F.min("d").alias("component_id")).join(classes, "comp").select("fp", "component_id")
    out = all_docs.join(named, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
