"""Normalisation of seller text as column expressions; Unicode compatibility forms need Python and are Arrow batched."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode NFKC, which Spark has no expression for; each text of a batch once, ASCII as it is. (Arrow's own function of that name doesn't compose.)"""
    coded = s.dictionary_encode()
    made = [x if x.isascii() else unicodedata.normalize("NFKC", x) for x in coded.dictionary.to_pylist()]
    return pa.array(made, pa.string()).take(coded.indices)


def collapse_space(c: Column) -> Column:
    """White space of any kind, the ideographic space included, as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Tags out, common character references decoded, white space collapsed."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("yen", "¥"), ("amp", "&")):
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    return collapse_space(c)


def parse_yen(c: Column) -> Column:
    """A price in yen: full-width digits count, thousands may be split; with a ¥ or 円 mark, else a bare number; else null."""
    plain = F.translate(c, "０１２３４５６７８９，￥", "0123456789,¥")
    marked = F.coalesce(
        F.nullif(F.regexp_extract(plain, r"¥\s*([0-9][0-9,\s]*)", 1), F.lit("")), F.nullif(F.regexp_extract(plain, r"([0-9][0-9,\s]*)\s*円", 1), F.lit(""))
    )
    bare = F.nullif(F.regexp_extract(plain, r"^\s*([0-9][0-9,]*)\s*$", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(marked, bare), r"[,\s]", "").try_cast("bigint")


def availability(sold_out: Column, in_stock: Column) -> Column:
    """Stock status from two signals; signals that contradict each other say nothing."""
    return F.when(sold_out & ~in_stock, "sold_out").when(in_stock & ~sold_out, "in_stock").otherwise("unknown")


def safe_url(c: Column) -> Column:
    """The address if it is http or https, else the empty string."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"(?i)^https?://[^/\s]+"), c).otherwise("")


def truncated(c: Column, size: int, mark: str = "…") -> Column:
    """At most size characters, the last ones a mark if anything was cut; NUL characters become U+FFFD."""
    c = F.translate(c, "\x00", "�")
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - len(mark)), F.lit(mark))).otherwise(c)


def _once(c: Column, step: Callable[[Column], Column]) -> Column:
    """step of c, with c computed once however often step names it, in filters and conditions too."""
    return F.element_at(F.transform(F.array(c), step), 1)


def identity_model(c: Column) -> Column:
    """A model name for comparison: `D-1000 MKII`, `D1000 MK2` and `D 1000 mk ii` are all D1000MK2."""
    # few names hold a mark or a roman number, and a look for one costs less than its patterns
    def marks(c: Column) -> Column:
        marked = c
        for roman, digit in (("III", "3"), ("II", "2"), ("IV", "4"), ("I", "1")):
            marked = F.regexp_replace(marked, rf"\b?(?:MARK|MK)[\s.\-]*{roman}(?![A-Z0-9])", f"MK{digit}")
        marked = F.regexp_replace(marked, r"MARK[\s.\-]*(?=[0-9])", "MK")
        return F.when(c.contains("MK") | c.contains("MARK"), marked).otherwise(c)

    def revisions(c: Column) -> Column:
        revised = c
        for roman, digit in (("III", "3"), ("II", "2"), ("IV", "4")):
            revised = F.regexp_replace(revised, rf"(?<=[\s\-]){roman}(?![A-Z0-9])", f"REV{digit}")
        return F.when(c.contains("II") | c.contains("IV"), revised).otherwise(c)

    c = _once(F.upper(F.translate(c, "‐‑‒–—―−ー", "-" * 8)), marks)
    return F.regexp_replace(_once(c, revisions), r"[^A-Z0-9]", "")


#: Endings that make another product of the same stem (fixed values).
VARIANTS = r"(MK[0-9]+|REV[0-9]+|SE|TX|D[0-9]|META|SIGNATURE|LIMITED|ANNIVERSARY|X|S)$"


def model_stem(normalized: Column) -> Column:
    return F.regexp_replace(normalized, VARIANTS, "")


def model_variant(normalized: Column) -> Column:
    return F.regexp_extract(normalized, VARIANTS, 1)
