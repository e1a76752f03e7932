"""Chat formatting with Spark expressions only: relational grouping, array functions, concatenation.

Template of a conversation: its rows in order of turn; adjacent rows of one role form one turn,

    <s>[INST] role [/INST] text[SEP]text...</s>

Control strings in roles and texts get a backslash after their first character, and those that have backslashes there
get one more, so no text can end a turn, and taking one backslash away gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, SEP, CLOSE = "<s>[INST] ", " [/INST] ", "[SEP]", "</s>"
_TAILS = r"(/?s>|/?INST\]|SEP\])"
_RAW, _ESCAPED = r"([<\[])(\\*)" + _TAILS, r"([<\[])\\(\\*)" + _TAILS


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _RAW, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1$2$3")


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): one row per conversation.

    loss_mask is array<struct<start, length>>, in code points of formatted: each text of the trained role, once, in
    order. Rows are sorted by turn, then role and text (null turns first), so equal turns have one defined order and
    repeated rows stay as repeated turns. A null role or text counts as empty. Rows whose conv_id is null form one
    conversation. An empty table gives no rows. Other columns are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda x: F.struct(escape(x.role).alias("role"), escape(x.text).alias("text"))).alias("t"))
    n = F.size("t")
    same = lambda i: F.element_at("t", i).role == F.element_at("t", i - 1).role
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, F.lit(True)).otherwise(~same(i)))
    chats = chats.withColumn("begins", begins)
    end = lambda j: F.when(j + 2 <= F.size("begins"), F.element_at("begins", j + 2)).otherwise(n + 1)
    merged = F.transform("begins", lambda b, j: F.struct(
        F.element_at("t", b).role.alias("role"),
        F.transform(F.slice("t", b, end(j) - b), lambda x: x.text).alias("texts"),
    ))
    chats = chats.select("conv_id", merged.alias("turns"))
    # every piece of the output with its role: heads and ends of turns have none
    pieces = F.flatten(F.transform("turns", lambda m: F.concat(
        F.array(F.struct(F.lit(False).alias("loss"), F.concat(F.lit(OPEN), m.role, F.lit(ROLE_END)).alias("s"))),
        F.flatten(F.transform(m.texts, lambda x, i: F.array(
            F.struct((m.role == trained_role).alias("loss"), x.alias("s")),
            F.struct(F.lit(False).alias("loss"), F.when(i + 1 < F.size(m.texts), F.lit(SEP)).otherwise(F.lit(CLOSE)).alias("s")),
        ))),
    )))
    chats = chats.select("conv_id", pieces.alias("pieces"))
    ends = running_sums(F.transform("pieces", lambda p: F.length(p.s).cast("long")))
    spans = F.zip_with("pieces", ends, lambda p, e: F.when(p.loss, F.struct((e - F.length(p.s)).alias("start"), F.length(p.s).cast("long").alias("length"))))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p.s), "").alias("formatted"), F.array_compact(spans).alias("loss_mask"))


def running_sums(sizes: Column) -> Column:
    """Sums of an array up to each place: every pass adds what stands 1, 2, 4, ... places before, as long as there is any."""
    def added(by: int):
        return lambda c: F.when(F.size(c) > by, F.transform(c, lambda x, i: x + F.coalesce(F.get(c, i - by), F.lit(0)))).otherwise(c)

    for k in range(31):
        sizes = F.get(F.transform(F.array(sizes), added(1 << k)), F.lit(0))
    return sizes


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the rows that a formatted conversation was made of, each with its own role and text."""
    turns = F.filter(F.split(formatted, CLOSE), lambda s: s != "")
    parts = lambda s: F.split(F.substring(s, len(OPEN) + 1, 1 << 30), r" \[/INST\] ", 2)
    one = lambda s: F.transform(F.split(parts(s)[1], r"\[SEP\]", -1), lambda x: F.struct(unescape(parts(s)[0]).alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(turns, one))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped piece by piece, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m.start + 1).cast("int"), m.length.cast("int")))), "")
