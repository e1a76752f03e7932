"""Other spellings of a model name, for search: small per-name work, done once for each name of a batch."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that make another product of the same stem, roman numbers of revisions, dashes.
WORDS = ("SIGNATURE", "ANNIVERSARY", "REFERENCE", "LIMITED", "META", "PRO", "TX", "SE")
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4"}
DASHES = "‐‑‒–—―－"
#: Spellings that are kept of a name, the shortest ones.
MOST = 8

_TO_ROMAN = {v: k for k, v in ROMAN.items()}
_MARK = re.compile(r"\bMARK[ ]*(?=(?:IV|I{1,3}|[1-9][0-9]*)\b)")
_MK = re.compile(r"MK[ ]*(IV|I{1,3})(?![A-Z])|\bMK[ ]+(?=[1-9])")
_ALONE = re.compile(r"(^|[ /_-])(IV|III|II)(?=$|[ /_-])")
_END = re.compile(r"(?P<mk>MK[1-9][0-9]*)$|(?P<rev>REV[2-4])$|(?P<word>" + "|".join(WORDS) + r"|X)$")


def plain(name: str | None) -> str:
    name = unicodedata.normalize("NFKC", name or "")
    return " ".join(name.translate({ord(d): "-" for d in DASHES}).split())


def parts(name: str | None) -> tuple[str, tuple[str, ...]]:
    """(stem, variants) of a name without separators: D-1000 MARK II Limited Edition is D1000, (MK2, LIMITED)."""
    text = _MARK.sub("MK", plain(name).upper())
    text = _MK.sub(lambda m: "MK" + ROMAN.get(m[1] or "", ""), text)
    text = re.sub(r"\bLIMITED +EDITION\b", "LIMITED", text)
    text = _ALONE.sub(lambda m: f" REV{ROMAN[m[2]]}", text)
    stem, found = re.sub(r"[^A-Z0-9]", "", text), []
    while m := _END.search(stem):
        rest = stem[: m.start()]
        # a word or an X is a variant only behind a number
        if not rest or (m["word"] and not re.search("[0-9]", rest)):
            break
        found.insert(0, m[0])
        stem = rest
    return stem, tuple(dict.fromkeys(found))


def _spelled(variant: str, roman: bool) -> str:
    number = variant.removeprefix("MK").removeprefix("REV")
    if number == variant:
        return "LIMITED EDITION" if roman and variant == "LIMITED" else variant
    return ("MK" if variant.startswith("MK") else "") + (_TO_ROMAN.get(number, number) if roman else number)


def spellings(name: str | None) -> list[str]:
    """At most MOST ways to write a model name, shortest first: as given, run together, with a dash, with roman numbers."""
    stem, variants = parts(name)
    if not stem:
        return []
    dashed = re.sub(r"^([A-Z]{1,4})(?=[0-9])", r"\1-", stem)
    out = {plain(name).upper(), stem + "".join(variants)}
    ways = [" ".join(_spelled(v, roman) for v in variants) for roman in (False, True)]
    for way in dict.fromkeys(ways):
        out |= {f"{s} {way}".strip() for s in ({stem, dashed} if variants else {dashed})}
    if ways[1] != ways[0]:
        out.add(stem + ways[1].replace(" ", ""))
    return sorted(out, key=lambda x: (len(x), x))[:MOST]


@F.arrow_udf(ArrayType(StringType()))
def model_spellings(names: pa.Array) -> pa.Array:
    coded = names.dictionary_encode()
    made = pa.array([spellings(n) for n in coded.dictionary.to_pylist()], pa.list_(pa.string()))
    return made.take(coded.indices)
