"""A stored index of trigrams with places: substring search and its ranking from postings alone, maintained by key.

Every place of every text has a posting of the three characters that begin there (texts are padded at their end). Postings are
partitioned by their first two characters and sorted, so a term reads the files of its own trigrams, and a term of one or two
characters those that begin with it. A change writes a new generation with the changed rows only; of a row's postings
those of its latest generation count. A generation counts once its totals are written, so one that broke off is as if it had
never begun, and is written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.search import plan_terms
from tidemark.sources.shared import exists, remove

BUCKETS = 64
#: Postings that a task sorts and writes, and rows of the index whose places a task of a search sums up, about; whatever the index's size.
PLACES, ROWS = 2_000_000, 50_000
#: Of the ranking, and what a term is worth at least that most rows hold (fixed values).
K1, B, LEAST = 1.2, 0.75, 1e-6


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 2)), F.lit(BUCKETS)).cast("int")


def grams(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(gram, id, col, pos, tokens): one posting a place; tokens are the row's trigrams without the padded ones."""
    low = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    tokens = reduce(lambda a, b: a + b, (F.greatest(F.length(t) - 2, F.lit(0)) for t in low)).cast("long")
    out = None
    for i, t in enumerate(low):
        at = rows.select(F.col(id_col).alias("id"), t.alias("t"), tokens.alias("tokens")).where("t <> ''")
        at = at.select("id", "tokens", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("pos"))
        at = at.select(F.substring(F.concat("t", F.lit("\0\0")), F.col("pos"), F.lit(3)).alias("gram"), "id", F.lit(i).alias("col"), "pos", "tokens")
        out = at if out is None else out.unionByName(at)
    return out


def _cover(term: str) -> list[tuple[str, int]]:
    """Trigrams of a term, with their places, that hold all of it."""
    last = len(term) - 3
    return [(term[i : i + 3], i) for i in [*range(0, last, 3), last]]


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    id_col: str
    columns: tuple[str, ...]

    def _stats(self) -> list[tuple[int, int, int, int]]:
        """(gen, base, rows, tokens) of each generation that counts; one row each."""
        if not exists(self.spark, f"{self.path}/stats"):
            return []
        found = self.spark.read.schema("base int, rows long, tokens long, gen int").parquet(f"{self.path}/stats").collect()
        return sorted((r.gen, r.base, r.rows, r.tokens) for r in found)

    def _live(self, name: str) -> DataFrame:
        """The table of all generations since the last whole one."""
        stats = self._stats()
        base = stats[-1][1]
        read = self.spark.read
        if name == "postings":  # an index without texts has no files of them to tell the columns
            kind = read.parquet(f"{self.path}/rows").schema["id"].dataType.simpleString()
            read = read.schema(f"gram string, id {kind}, col int, pos int, tokens long, gen int, bucket int")
        return read.parquet(f"{self.path}/{name}").where(F.col("gen").isin([g for g, *_ in stats if g >= base]))

    def _latest(self) -> DataFrame | None:
        """(id, latest) of rows that changed since the last whole generation; None if none did."""
        stats = self._stats()
        base = stats[-1][1]
        if stats[-1][0] == base:
            return None
        return self._live("rows").where(F.col("gen") > base).groupBy("id").agg(F.max("gen").alias("latest"))

    def postings(self, condition: Column | None = None) -> DataFrame:
        """Postings that count, of those that meet the condition on gram and bucket."""
        out = self._live("postings")
        out = out if condition is None else out.where(condition)
        latest = self._latest()
        if latest is None:
            return out
        return out.join(latest, "id", "left").where("latest IS NULL OR latest = gen").drop("latest")

    def _write(self, rows: DataFrame, gone: DataFrame | None, gen: int, base: int, count: int, tokens: int, places: int) -> None:
        """places: about how many postings rows have; count and tokens are the whole index's."""
        parts = max(1, -(-places // PLACES))
        found = grams(rows, self.id_col, list(self.columns)).withColumn("bucket", _bucket(F.col("gram")))
        found = found.repartitionByRange(parts, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id", "col", "pos")
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        kept = self._lengths(rows)
        if gone is not None:
            kept = kept.unionByName(gone.select(F.col(self.id_col).alias("id"), F.lit(None).cast("long").alias("tokens")))
        kept.write.mode("overwrite").parquet(f"{self.path}/rows/gen={gen}")
        made = self.spark.range(1).select(F.lit(base).alias("base"), F.lit(count).cast("long").alias("rows"), F.lit(tokens).cast("long").alias("tokens"))
        made.write.mode("overwrite").parquet(f"{self.path}/stats/gen={gen}")

    def _places(self, rows: int, tokens: int) -> int:
        return tokens + 2 * len(self.columns) * rows

    def _lengths(self, rows: DataFrame) -> DataFrame:
        low = [F.length(F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in self.columns]
        return rows.select(F.col(self.id_col).alias("id"), reduce(lambda a, b: a + b, (F.greatest(n - 2, F.lit(0)) for n in low)).cast("long").alias("tokens"))

    def create(self, rows: DataFrame) -> TextIndex:
        """Write the index of rows as a whole generation: the first one, or one that takes the place of all before."""
        stats = self._stats()
        gen = stats[-1][0] + 1 if stats else 0
        n, tokens = self._lengths(rows).agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self._write(rows, None, gen, gen, n, tokens, self._places(n, tokens))
        return self

    def apply(self, changed: DataFrame, deleted: DataFrame | None = None) -> TextIndex:
        """Rows that are new or changed, and ids that are gone; each id once, in one of the two."""
        gen, base, count, tokens = self._stats()[-1]
        ids = changed.select(F.col(self.id_col).alias("id"))
        ids = ids if deleted is None else ids.unionByName(deleted.select(F.col(self.id_col).alias("id")))
        before = self._live("rows").join(ids, "id", "left_semi").groupBy("id").agg(F.max_by("tokens", "gen").alias("tokens")).where("tokens IS NOT NULL")
        had, had_tokens = before.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        new, new_tokens = self._lengths(changed).agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self._write(changed, deleted, gen + 1, base, count - had + new, tokens - had_tokens + new_tokens, self._places(new, new_tokens))
        return self

    def compact(self, rows: DataFrame) -> TextIndex:
        """One whole generation of rows again; then the files of those before go."""
        old = [g for g, *_ in self._stats()]
        self.create(rows)
        remove(self.spark, *(f"{self.path}/{name}/gen={g}" for g in old for name in ("stats", "rows", "postings")))
        return self

    def occurrences(self, terms: list[str]) -> DataFrame:
        """(id, term, col, pos, tokens): each place of each term (by its number), from the postings of its own trigrams."""
        gram = F.col("gram")
        long = {i: _cover(t) for i, t in enumerate(terms) if len(t) >= 3}
        asked = sorted({g for cover in long.values() for g, _ in cover})
        short = {i: t for i, t in enumerate(terms) if len(t) < 3}
        buckets = [gram.isin(asked) & F.col("bucket").isin(self._buckets(asked))] if asked else []
        # one character alone may begin the trigrams of any bucket
        buckets += [gram.startswith(t) & F.col("bucket").isin(self._buckets([t])) if len(t) == 2 else gram.startswith(t) for t in short.values()]
        found = self.postings(reduce(lambda a, b: a | b, buckets))
        part = lambda i, at: F.struct(F.lit(i).alias("term"), F.lit(at).alias("at"))
        parts = [F.when(gram == g, part(i, at)) for i, cover in long.items() for g, at in cover]
        parts += [F.when(gram.startswith(t), part(i, 0)) for i, t in short.items()]
        found = found.select("id", "col", "pos", "tokens", F.explode(F.array_compact(F.array(*parts))).alias("p"))
        # all that follows goes by id: one shuffle, and no map of places before it, where hardly two have a key in common
        found = found.repartition(max(1, -(-self._stats()[-1][2] // ROWS)), "id")
        found = found.groupBy("id", "col", "p.term", (F.col("pos") - F.col("p.at")).alias("pos")).agg(F.count("*").alias("n"), F.min("tokens").alias("tokens"))
        need = F.coalesce(*(F.when(F.col("term") == i, len(cover)) for i, cover in long.items()), F.lit(1))
        return found.where(F.col("n") == need).select("id", "term", "col", "pos", "tokens")

    def _buckets(self, grams: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()
        return sorted(r.b for r in rows)

    def search(self, query: str, weights: list[float] | None = None) -> DataFrame:
        """(id, score) of rows in which every term of the query stands in some column, whatever the case; higher scores are better.

        Scores are bm25 over terms of three characters or more: places by their column's weight, lengths in trigrams,
        both over the whole index. Shorter terms only select. Without terms nothing is found.
        """
        terms = plan_terms(query)
        if not terms:
            return self.occurrences(["\0\0\0"]).select(F.col("id").alias(self.id_col), F.lit(0.0).alias("score"))
        _, _, count, tokens = self._stats()[-1]
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights or [1.0] * len(self.columns))), F.col("col") + 1)
        by_term = self.occurrences(terms).groupBy("id", "term").agg(F.sum(weight).alias("f"), F.min("tokens").alias("tokens"))
        n = F.col("rows_with")
        idf = F.greatest(F.log((F.lit(count) - n + 0.5) / (n + 0.5)), F.lit(LEAST))
        # a row for each of at most twelve terms
        worth = by_term.groupBy("term").agg(F.count("*").alias("rows_with")).select("term", idf.alias("idf"))
        average = max(tokens, 1) / max(count, 1)
        score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("tokens") / average))
        ranked = F.when(F.col("term").isin([i for i, t in enumerate(terms) if len(t) >= 3]), score).otherwise(0.0)
        out = by_term.join(F.broadcast(worth), "term").groupBy("id").agg(F.sum(ranked).alias("score"), F.count("*").alias("n"))
        return out.where(F.col("n") == len(terms)).select(F.col("id").alias(self.id_col), "score")

    def check(self, rows: DataFrame) -> DataFrame:
        """(id, problem) where the index isn't what rows give: missing, extra, or differs. Empty if all is well.

        Postings of both sides are counted and their hashes combined for each row, before rows meet.
        """
        def summed(places: DataFrame, name: str) -> DataFrame:
            return places.groupBy("id").agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64("gram", "col", "pos", "tokens"))).alias(name))

        want = self._lengths(rows).select("id", F.lit(True).alias("wanted")).join(summed(grams(rows, self.id_col, list(self.columns)), "w"), "id", "left")
        listed = self._live("rows").groupBy("id").agg(F.max_by("tokens", "gen").alias("tokens")).where("tokens IS NOT NULL").select("id", F.lit(True).alias("listed"))
        have = listed.join(summed(self.postings(), "h"), "id", "full")
        out = want.join(have, "id", "full")
        problem = F.when(F.col("wanted").isNull(), "extra").when(F.col("listed").isNull(), "missing").when(~F.col("w").eqNullSafe(F.col("h")), "differs")
        return out.select(F.col("id").alias(self.id_col), problem.alias("problem")).where("problem IS NOT NULL")
