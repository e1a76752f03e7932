"""Line dedup: a segment-partition edit join over the distinct lines of all documents, with Spark expressions only.

A line goes if an earlier line is equal to it or near it. Near is counted in words (what stands between spaces; a character
of a script without spaces is a word): at most t words changed, inserted or left out, where t grows with the shorter
line's length.

1. Lines of m words are of class m // PER_EDIT, and t + 1 segments are laid over as many words as the shortest of a class has. If
   y has m words and x has m + d, and they are within t edits, one of y's segments stands unchanged in x, at a place that
   the edits before and after it narrow down. So y waits under (class, segment number, segment), and x asks in its own
   class, and in the one below if it is at most t words longer than that, at each such place. What y's other words are, and
   how many, isn't part of a key: one place serves every d. Only keys that two different lines share are looked at again,
   by a broadcast of four bytes a key, in rounds if there are too many of them: lines' words are never shuffled for the others.
2. Under each key all are held against the earliest that waits and the earliest that asks. A line that is near an earlier
   one is settled, whatever else stands there: groups of copies, however large, end here.
3. What is open is held against all that stand under its keys, if that makes few pairs for each line. Else the segment
   shared under a large key is cut out, and what is left of its lines is partitioned again, where lines of one template
   tell each other apart: a key's pairs are never made in the square of its lines.
4. The distance is computed bit-parallel in a band of 2 t + 1 diagonals (one bit each) that moves down the lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Words of the shorter line for each edit that is allowed, and the most edits (8 at most: a line's keys grow
#: with their square). Lines of fewer words than PER_EDIT are only compared for equality.
EDITS, PER_EDIT = 4, 10
#: Pairs for each line up to which open lines are held against all that stand under their keys; beyond it keys are divided.
FEW = 16
#: Keys (four bytes each) that are broadcast at once; more are taken in rounds.
KEYS = 8_000_000
#: Scripts that are written without spaces.
_UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def split_lines(docs: DataFrame) -> DataFrame:
    """(at, line) for every line that isn't blank (white space only). at is its place: (doc_id is known, doc_id, hash of the
    text, number of the line), which sorts null ids first and tells apart the texts of a repeated id. A null text has none."""
    lines = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    at = F.struct(F.col("d").isNotNull().alias("known"), F.coalesce("d", F.lit(0)).cast("long").alias("d"), "th", "i")
    return lines.where(F.col("line").rlike(r"\S")).select(at.alias("at"), "line")


def words(line: Column) -> Column:
    return F.split(F.when(F.octet_length(line) > 2 * F.length(line), F.regexp_replace(line, _UNSPACED, " $1 ")).otherwise(line), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of arrays a and b, b not the shorter one, exact up to `edits`, more than that beyond.

    In the column of b's word j, bit k stands for row j - edits + k of a. vp and vn say where the distance rises or falls by
    one from a row to the next, d0 where it stays the same along the diagonal; after each word the band moves by a row.
    """
    one = lambda v: F.lit(v).cast("long")
    mask, more = one((1 << (2 * edits + 1)) - 1), F.size(b) - F.size(a)
    match = F.transform(b, lambda y, j: reduce(lambda x, z: x.bitwiseOR(z), (F.when(F.get(a, j - edits + k) == y, one(1 << k)).otherwise(one(0)) for k in range(2 * edits + 1))))

    def step(s: Column, m: Column) -> Column:
        def after(d0: Column) -> Column:
            def moved(hp: Column) -> Column:
                down = F.shiftright(d0, 1)
                vp = d0.bitwiseAND(s.vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask)
                stays = F.expr("1L") - F.call_function("shiftright", d0, edits - more).bitwiseAND(one(1))
                return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s.j + 1).alias("j"), F.when(s.j >= more, s.sum + stays).otherwise(s.sum).alias("sum"))

            return _let(s.vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(s.vp))).bitwiseAND(mask), moved)

        x = m.bitwiseOR(s.vn)
        return _let((x.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp).bitwiseOR(x).bitwiseAND(mask), after)

    start = F.struct(one(((1 << (edits + 1)) - 1) << edits).alias("vp"), one(0).alias("vn"), F.lit(0).alias("j"), more.cast("long").alias("sum"))
    return F.aggregate(match, start, step, lambda s: s.sum)


def near(a: Column, b: Column, most: Column, edits: int) -> Column:
    """Whether a and b are within `most` edits: first by the words that one has and the other lacks, then by the distance."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    few = (F.abs(F.size(a) - F.size(b)) <= most) & (F.size(F.array_except(a, b)) <= most) & (F.size(F.array_except(b, a)) <= most)
    return F.when(few, _let(F.struct(short.alias("s"), long.alias("l")), lambda p: distance(p.s, p.l, edits) <= most)).otherwise(False)


def places(edits: int, more: int) -> list[tuple[int, int]]:
    """(segment, shift): where a line asks for segments of one that is `more` words shorter. Each unchanged segment moves the number of
    edits before it (a word put in before a segment counts for it) nearer to its own number, from segment 0 on, and past
    the last segment it is smaller. So some unchanged segment i has just i edits before it, and at most edits - i after it."""
    return [(i, a) for i in range(edits + 1) for a in range(-i, i + 1) if abs(more - a) <= edits - i]


def first_cuts(edits: int, per_edit: int) -> Column:
    """The ways to take part of a line of n words, by its class n // per_edit and n % per_edit: t, how many classes down, role
    (0 waits, 1 asks), the segment, its shift, whether there is a key of the segment before with that shift, and how many words
    shorter the lines asked for may be, at least and at most."""
    arrays = []
    for k in range(1, edits + 2):
        for r in range(edits + 1):  # more words than edits over the class change nothing
            t = min(edits, k)
            rows = [(t, 0, 0, i, 0, i > 0, 0, 0) for i in range(t + 1)]
            for down, t, low, high in ((0, t, 0, min(t, r)), (1, min(edits, k - 1), r + 1, min(edits, k - 1))):
                for i, a in ((i, a) for i in range(t + 1) for a in range(-i, i + 1)):
                    least, most = max(low, a - t + i), min(high, a + t - i)
                    rows += [(t, down, 1, i, a, abs(a) < i, least, most)] * (t > 0 and least <= most)
            arrays.append(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("t", "down", "role", "i", "shift", "before", "least", "most"), row))) for row in rows)))
    return F.get(F.array(*arrays), F.expr(f"(least(n div {per_edit}, {edits + 1}) - 1) * {edits + 1} + least(n % {per_edit}, {edits})").cast("int"))


def rest_cuts(edits: int) -> Column:
    """The same for what is left of a line, by its columns: number of parts, role, the segment, its shift, and whether there is a key of
    the segment before. It may have t words or less: then each word is a segment, and any word of the other may be it; and
    for pairs that share no more words (segment -1) the shift says by its bits which gaps between cut words they share."""
    rows = []
    for t in range(1, edits + 1):
        rows += [(t, t + 1, 0, 0, i, 0, i > 0) for i in range(t + 1)]
        rows += [(t, t + 1, 1, more, i, a, (i - 1, a) in places(t, more)) for more in range(t + 1) for i, a in places(t, more)]
        for parts in range(t + 1):
            rows += [(t, parts, 0, 0, i, 0, False) for i in range(parts)]
            rows += [(t, parts, 1, 0, i, j - i, False) for i in range(parts) for j in range(parts + t)]
            rows += [(t, parts, role, 0, -1, bits, False) for role in (0, 1) for bits in range(1 << t)]
    names = ("t", "parts", "role", "more", "i", "shift", "before")
    array = lambda rows: F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row))) for row in rows))
    out = F.when(F.lit(False), array(rows))
    for t, role, more in ((t, role, more) for t in range(1, edits + 1) for role in (0, 1) for more in range(t * role + 1)):
        own = [r for r in rows if r[0] == t and r[2] == role]
        some = F.expr(f"t = {t} AND role = {role}" + f" AND more = {more}" * role)
        out = out.when(some & (F.col("m") > t), array([r for r in own if r[1] > t and r[3] == more]))
        for parts in range(t + 1):
            out = out.when(some & (F.col("m") == parts), array([r for r in own if r[1] == parts]))
    return out


def keyed(lines: DataFrame, keep: list[str], edits: int, per_edit: int | None = None) -> DataFrame:
    """lines with role, key, q, start, size, t, least and most for each place where they wait or ask: of whole lines (words w), or,
    without per_edit, of what is left of them (words r, each with the number g of cut words before it) under their key.

    A key is (least number of words m of the lines that wait, segment, its words). The first segments are shorter by one. q is the
    segment before, read without another shift: two lines that agree on it as well are left to its own key, if there is one,
    for what stands equal before an equal segment can be cut out with it, and the distance stays the same. Where no such
    key is, q is 0 for a line that waits and 1 for one that asks.
    """
    rest = per_edit is None
    out = lines.withColumn("n", F.size("r" if rest else "w"))
    if rest:
        out = out.withColumn("more", F.explode(F.sequence("least", "most")))
        out = out.withColumn("m", F.expr("n - IF(role = 0, 0, more)")).withColumn("c", F.explode(rest_cuts(edits))).withColumn("parts", F.col("c.parts"))
        # gaps: lines of m and n words that share b gaps and no words are m + n - b edits apart
        out = out.where("c.i >= 0 OR n <= t AND c.shift < shiftleft(1, n) AND (role = 0 OR bit_count(c.shift) >= m + n - t)")
    else:
        out = out.where(f"n >= {per_edit}").withColumn("c", F.explode(first_cuts(edits, per_edit)))
        out = out.withColumns({"m": F.expr(f"cast((n div {per_edit} - c.down) * {per_edit} AS int)"), "parts": F.expr("c.t + 1")})
    out = out.withColumns({"base": F.expr("IF(c.i < 0, 0, cast(m div greatest(parts, 1) AS int))"), "short": F.expr("IF(c.i < 0, 0, parts - m % greatest(parts, 1))")})
    out = out.withColumns({"a": F.expr("IF(c.i < 0, 0, c.i * base + greatest(0, c.i - short) + c.shift)"), "z": F.expr("IF(c.i < 0, 0, base + IF(c.i >= short, 1, 0))")})
    out = out.where("a >= 0 AND a + z <= n")
    # the segment before ends where this one starts, and is as long, or shorter by one
    out = out.withColumn("y", F.expr("IF(c.i - 1 >= short, base + 1, base)"))
    part = lambda s, z: f"slice(r, {s}, {z}), slice(g, {s}, {z})" if rest else f"slice(w, {s}, {z})"
    key = f"xxhash64(m, c.i, {part('a + 1', 'z')})"
    if rest:
        key = f"IF(c.i < 0, xxhash64(key, c.i, filter(g, (x, k) -> getbit(c.shift, k) = 1)), xxhash64(key, m, c.i, {part('a + 1', 'z')}))"
    least, most = ("more", "more") if rest else ("c.least", "c.most")
    return out.select(
        *keep, F.expr(key).alias("key"), F.expr(f"IF(c.before AND a >= y, xxhash64({part('greatest(a - y, 0) + 1', 'y')}), cast(c.role AS long))").alias("q"),
        F.col("c.role").alias("role"), F.col("a").alias("start"), F.col("z").alias("size"), F.col("c.t").alias("t"), F.col(least).alias("least"), F.col(most).alias("most"),
    )


def under(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose key is one of keys, by 48 bits of it, which are broadcast; a row that these let in wrongly shares its key with no other line."""
    place, rest = F.col("key").bitwiseAND(65535).cast("int"), F.shiftright("key", 32).cast("int")
    held = keys.groupBy(place.alias("_place")).agg(F.collect_list(rest).alias("_rests"))
    return rows.join(F.broadcast(held), (place == F.col("_place")) & F.array_contains("_rests", rest), "left_semi")


def near_lines(docs: DataFrame, edits: int, per_edit: int, few: int = FEW) -> DataFrame:
    """(at) of the distinct lines that have an earlier line near them but not equal."""
    lines = split_lines(docs).select("at", F.xxhash64("line").alias("h"), words(F.col("line")).alias("w"))
    # equal lines are one: those of a task before the shuffle, and a key counts only if two different ones have it
    own, ask = (F.when(F.col("role") == r, F.col("h")) for r in (0, 1))
    keys = keyed(lines, ["h"], edits, per_edit).groupBy("key").agg(F.min(own).alias("o0"), F.max(own).alias("o1"), F.min(ask).alias("a0"), F.max(ask).alias("a1"))
    # tables go as soon as nothing reads them any more: those of the keys, those of a level, those of a pass
    spark, above, at_level, of_pass = docs.sparkSession, Scratch(), Scratch(), Scratch()
    keys = at_level(keys.where("o0 <> a0 OR o0 <> a1 OR o1 <> a0").select("key"), "keys")
    level, rounds = None, -(-keys.count() // KEYS)
    for k in range(max(rounds, 1)):
        some = keys if rounds < 2 else keys.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        part = under(keyed(lines, ["at", "h", "w"], edits, per_edit), some).groupBy("key", "role", "h", "start", "size", "t", "least", "most", "q")
        part = part.agg(F.min("at").alias("at"), F.first(F.transform("w", lambda x: F.xxhash64(x))).alias("w")).drop("h")
        part = part if rounds < 2 else at_level(part, "lines-of-a-round")
        level = part if level is None else level.unionByName(part)
    own, ask = F.col("role") == 0, F.col("role") == 1
    settled, limit = None, 0
    while True:
        level = at_level(level, "lines-by-key")
        above.clear(spark)
        limit = limit or few * level.count()
        # partners of a row: those that stand on the other side under its key, without those of its own class
        by_class = level.groupBy("key", "q").agg(F.count_if(own).alias("own_q"), F.count_if(ask).alias("ask_q"))
        by_key = by_class.groupBy("key").agg(F.sum("own_q").alias("n_own"), F.sum("ask_q").alias("n_ask"))
        n = F.when(own, F.col("n_ask") - F.col("ask_q")).otherwise(F.col("n_own") - F.col("own_q"))
        met = of_pass(level.join(by_class.join(by_key, "key"), ["key", "q"]).withColumn("n", n).where("n > 0").drop("own_q", "ask_q", "n_own", "n_ask"), "lines-that-meet")
        at_level.clear(spark)
        first = F.struct("at", "w", "q")
        hubs = met.groupBy("key").agg(F.min(F.when(own, first)).alias("own"), F.min(F.when(ask, first)).alias("ask"), F.count("*").alias("members"))
        beside = met.join(hubs, "key").withColumn("hub", F.when(own, F.col("ask")).otherwise(F.col("own"))).where("hub.at < at")
        tried = beside.select("key", "q", "role", "at", "w", "t", "n", "members", ((F.col("hub.q") != F.col("q")) & near(F.col("w"), F.col("hub.w"), F.col("t"), edits)).alias("near"))
        tried = of_pass(tried, "beside-hubs")
        now = tried.where("near").select("at")
        settled = of_pass((now if settled is None else settled.unionByName(now)).distinct(), "settled")
        todo = of_pass(tried.where("NOT near").join(settled, "at", "left_anti"), "open")
        # all that is open is held against all it stands beside, as long as that is in proportion to the lines: few for each
        work = todo.groupBy("key").agg(F.sum("n").alias("pairs"), F.first("members").alias("members"))
        hot = work.where(F.col("pairs") > few * F.col("members")).select("key", "pairs")
        hot = hot.select("key") if (hot.agg(F.sum("pairs")).first()[0] or 0) > limit else None
        some = (todo if hot is None else todo.join(hot, "key", "left_anti")).select("key", (1 - F.col("role")).alias("role"), "q", "at", "w", "t")
        other = met.select("key", "role", F.col("q").alias("q_2"), F.col("at").alias("at_2"), F.col("w").alias("w_2"))
        pairs = some.join(other, ["key", "role"]).where("at_2 < at AND q <> q_2").where(near(F.col("w"), F.col("w_2"), F.col("t"), edits))
        settled = materialize(settled.unionByName(pairs.select("at")).distinct(), "settled")
        if hot is None:
            of_pass.clear(spark)
            return settled
        above, of_pass = of_pass, Scratch()
        if "r" not in met.columns:
            met = met.withColumns({"r": F.col("w"), "g": F.array_repeat(F.lit(0), F.size("w"))})
        head = lambda c: F.slice(c, F.lit(1), F.col("start"))
        tail = lambda c: F.slice(c, F.col("start") + F.col("size") + 1, F.size(c))
        cut = {"r": F.concat(head("r"), tail("r")), "g": F.concat(head("g"), F.transform(tail("g"), lambda x: x + F.col("size")))}
        level = keyed(met.join(hot, "key").withColumns(cut), ["at", "w", "r", "g"], edits).distinct()


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, few: int = FEW) -> DataFrame:
    """docs with text without its repeated lines, n_lines, n_equal and n_near (lines gone by equality, by edits).

    A line goes if an earlier one is equal, or is at most min(edits, m // per_edit) words away, where m is the number of
    words of the shorter line; whether that earlier line itself stays doesn't matter. Earlier is by doc_id, then by place.
    Blank lines (white space only) stay. A null text stays null; a text all of whose lines go becomes '' (or its blank
    lines). A null doc_id comes first in the order. Texts of a repeated doc_id are told apart by their hash; rows that
    repeat both are one document, and what stays of it stays in each of them. Other columns, whatever their names, are
    carried along; columns n_lines, n_equal and n_near of docs are replaced. An empty table gives no rows.
    """
    if not 1 <= edits <= 8 or per_edit < edits + 1:
        raise ValueError("edits must be from 1 to 8, and per_edit more than edits")
    docs = docs.drop("n_lines", "n_equal", "n_near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal lines meet by 128 bits of hash; map-side minimums keep a line that is everywhere from filling one task
    firsts = split_lines(texts).groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.min("at").alias("at"))
    flags = firsts.select("at", F.lit(False).alias("near")).unionByName(near_lines(texts, edits, per_edit, few).withColumn("near", F.lit(True)))
    flags = flags.groupBy("at").agg(F.max("near").alias("near"))
    kept = flags.groupBy("at.known", "at.d", "at.th").agg(
        F.array_sort(F.collect_list(F.when(~F.col("near"), F.col("at.i")))).alias("keep"), F.count_if("near").alias("near")
    )
    # split before the join and joined as lines: an expression inside a lambda would be evaluated for each line anew
    of = lambda c: F.col(f"`{c}`")
    others = F.struct(*(of(c) for c in docs.columns if c != "text"), F.lit(0).alias("\0"))
    rows = docs.select(
        others.alias("row"), F.split(of("text").cast("string"), "\n").alias("parts"), of("doc_id").isNotNull().alias("known"),
        F.coalesce(of("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(of("text").cast("string")).alias("th"),
    )
    out = rows.join(kept, ["known", "d", "th"], "left")
    blank = F.array_compact(F.transform("parts", lambda x, i: F.when(~x.rlike(r"\S"), i)))
    out = out.select("row", "parts", "near", blank.alias("blank"), F.coalesce("keep", F.array().cast("array<int>")).alias("keep"))
    text = F.array_join(F.transform(F.array_sort(F.concat("keep", "blank")), lambda i: F.get("parts", i)), "\n")
    count = lambda c: F.when(F.col("parts").isNull(), 0).otherwise(c).cast("long")
    n_lines, n_near = F.size("parts") - F.size("blank"), F.coalesce("near", F.lit(0))
    return out.select(
        *(F.when(F.col("parts").isNotNull(), text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns),
        count(n_lines).alias("n_lines"), count(n_lines - F.size("keep") - n_near).alias("n_equal"), count(n_near).alias("n_near"),
    )
