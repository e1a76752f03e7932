"""Product rows from web pages: JSON-LD first, then links that stand near a price."""

from __future__ import annotations

import html as _html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)
_ANCHOR = re.compile(r"<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
_PRICE = re.compile(r"[¥￥]\s*([0-9][0-9,]*)|([0-9][0-9,]*)\s*円")
SCHEMA = "url string, position int, source_id string, title string, price_yen long, stock_status string"


def _plain(x: str) -> str:
    return " ".join(_html.unescape(re.sub(r"<[^>]*>", " ", x)).split())


def _products(node):
    if isinstance(node, list):
        for x in node:
            yield from _products(x)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
            yield node
        for x in node.values():
            yield from _products(x)


def _yen(digits: str) -> int | None:
    """None for no digits, and for numbers that a long doesn't hold."""
    return int(digits) if 0 < len(digits) <= 18 else None


def parse(page: str) -> list[tuple]:
    out = []
    for block in _SCRIPT.findall(page):
        try:
            nodes = list(_products(json.loads(block)))
        except (ValueError, RecursionError):  # not JSON, or nested deeper than any product is
            continue
        for p in nodes:
            offer = p.get("offers") or {}
            offer = offer[0] if isinstance(offer, list) and offer else offer
            offer = offer if isinstance(offer, dict) else {}
            price = re.sub(r"[^0-9]", "", str(offer.get("price", "")).split(".")[0])
            stock = str(offer.get("availability", ""))
            status = "in_stock" if stock.endswith("InStock") else "sold_out" if stock.endswith(("OutOfStock", "SoldOut")) else "unknown"
            out.append((str(p.get("url") or offer.get("url") or p.get("sku") or ""), _plain(str(p.get("name", "")))[:220], _yen(price), status))
    if out:
        return out
    for m in _ANCHOR.finditer(page):
        near = _plain(page[max(0, m.start() - 500) : m.end() + 900])
        price = _PRICE.search(near)
        if price:
            status = "sold_out" if re.search(r"sold ?out|売り切れ|売約済", near, re.I) else "unknown"
            out.append((m[1], _plain(m[2])[:220], _yen((price[1] or price[2]).replace(",", "")), status))
    return out


def products(pages: DataFrame) -> DataFrame:
    """Rows of all pages, where they are read. A null page has none."""

    def run(batches):
        for batch in batches:
            rows = [(u, i, *x) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(parse(h or ""))]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["url", "position", "source_id", "title", "price_yen", "stock_status"])

    return pages.select("url", "html").mapInArrow(run, SCHEMA)


def best_rows(rows: DataFrame) -> DataFrame:
    """One row a source id: known stock 500, a title 200, a price 100, and the title's length up to 180; first wins ties."""
    score = F.when(F.col("stock_status") != "unknown", 500).otherwise(0) + F.when(F.col("title") != "", 200).otherwise(0) + F.when(F.col("price_yen").isNotNull(), 100).otherwise(0) + F.least(F.length("title"), F.lit(180))
    order = Window.partitionBy("source_id").orderBy(F.desc(score), "url", "position")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def links(pages: DataFrame) -> DataFrame:
    """(url, link, text): links of each page to its own host, each once with its longest text."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>.*?</a>"), 0)
    rows = pages.select("url", F.explode(found).alias("a"))
    link = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']+)", 1)
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(origin, r"^(https?:)", 1)
    link = F.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(link)
    text = F.trim(F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("url", link.alias("link"), text.alias("text"), origin.alias("o")).where(F.col("o") == F.regexp_extract("link", r"^(https?://[^/?#]+)", 1)).where("o <> ''")
    return rows.groupBy("url", "link").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
