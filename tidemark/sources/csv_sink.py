"""The CSV dialect of exports: BOM, CRLF, all strings quoted, formula guard; cells held to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """A quoted string; text that a spreadsheet would run as a formula gets an apostrophe before it."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def lines(df: DataFrame, order: list[str], budget: int = 4096) -> DataFrame:
    """(order columns, line): one CSV line a row, with the names of the cells that were cut in a last cell."""
    cut = F.array_compact(F.array(*(F.when(F.length(F.col(c).cast("string")) > budget, F.lit(c)) for c in df.columns)))
    cells = [cell(F.substring(F.col(c).cast("string"), 1, budget)) for c in df.columns]
    return df.select(*order, F.concat_ws(",", *cells, cell(F.array_join(cut, "|"))).alias("line"))


def header(df: DataFrame) -> str:
    return "﻿" + ",".join(f'"{c}"' for c in [*df.columns, "csv_fields_truncated"])


def write(df: DataFrame, path: str, order: list[str], budget: int = 4096) -> None:
    """Parts ordered by the given columns; the header is the first line of the first part."""
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    body = lines(df, order, budget).select(F.lit(1).alias("_part"), *key, "line")
    # the header is a row of its own before all others, so it is there without rows too
    kinds = {f.name: f.dataType for f in body.schema.fields}
    first = df.sparkSession.range(1).select(F.lit(0).alias("_part"), *(F.lit(None).cast(kinds[f"_k{i}"]).alias(f"_k{i}") for i in range(len(order))), F.lit(header(df)).alias("line"))
    names = ["_part", *(f"_k{i}" for i in range(len(order)))]
    body = first.unionByName(body).repartitionByRange(*names).sortWithinPartitions(*names)
    body.select(F.col("line").alias("value")).write.option("lineSep", "\r\n").text(path)
