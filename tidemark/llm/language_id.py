"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes, of orders 0 to 3, with escape probabilities (method C: an escape weighs as
much as the number of different bytes that followed the context). The statistics are frozen after training, so the code
length of a text is a sum over its bytes; the language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing

ORDER = 3
#: Documented bound of the training sample: whole texts of so many rows of each language, those of smallest hash.
TRAIN_ROWS = 400


@dataclass
class Model:
    """keys[k]: sorted (k+1)-grams seen after contexts of order k in any language; cost[k]: bits in each language.
    contexts[k], escape[k]: the same for contexts, with the bits of an escape (0 where a language lacks the context)."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)


def grams(data: bytes, order: int) -> np.ndarray:
    """(order + 1)-grams as numbers; a text begins after `order` zero bytes, which UTF-8 text doesn't hold otherwise."""
    b = np.frombuffer(b"\0" * order + data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(data), dtype=np.uint32)
    for i in range(order + 1):
        out = (out << np.uint32(8)) | b[i : i + len(data)]
    return out


def fit_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of 4-grams, from which those of the lower orders follow."""

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, n = np.unique(grams(text.encode(), ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(releasing(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_model(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Costs under method C, from order 0 upwards: each order needs the cost of its suffix at the order below."""
    model = Model(languages)
    size = len(languages)
    for order in range(ORDER + 1):
        own = gram & ((1 << 8 * (order + 1)) - 1)
        keys = np.unique(own)
        count = np.zeros((len(keys), size))
        np.add.at(count, (np.searchsorted(keys, own), lang), n)
        contexts = np.unique(keys >> 8)
        where = np.searchsorted(contexts, keys >> 8)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, where, count)
        np.add.at(kinds, where, count > 0)
        known = total > 0
        escape = np.where(known, np.log2(np.where(known, total + kinds, 1)) - np.log2(np.where(known, kinds, 1)), 0.0)
        below = np.full((len(keys), size), 8.0) if order == 0 else model.cost[-1][np.searchsorted(model.keys[-1], keys & ((1 << 8 * order) - 1))]
        cost = np.where(count > 0, np.log2(np.where(count > 0, (total + kinds)[where], 1)) - np.log2(np.where(count > 0, count, 1)), escape[where] + below)
        model.keys.append(keys.astype(np.uint32))
        model.cost.append(cost)
        model.contexts.append(contexts.astype(np.uint32))
        model.escape.append(escape)
    return model


def code_lengths(model: Model, text: str) -> np.ndarray:
    """Bits of the whole text in each language."""
    bits = np.zeros(len(model.languages))
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(data), 1 << 20):  # memory is bounded for texts of any length; the context is carried over
        from_ = max(0, at - ORDER)
        g = grams(data[from_ : at + (1 << 20)], ORDER)[at - from_ :]
        for order in range(ORDER, -1, -1):
            keys = model.keys[order]
            own = g & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else g
            at_key = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[at_key] == own
            bits += model.cost[order][at_key[seen]].sum(axis=0)
            g = g[~seen]
            if not len(g):
                break
            context = own[~seen] >> np.uint32(8)
            at_context = np.minimum(np.searchsorted(model.contexts[order], context), len(model.contexts[order]) - 1)
            had = model.contexts[order][at_context] == context
            bits += model.escape[order][at_context[had]].sum(axis=0)
        bits += 8.0 * len(g)  # order -1: any byte alike
    return bits


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on the bounded sample. Rows with null text, null lang or empty text teach nothing. None without any such row."""
    ids = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    languages = sorted(r.lang for r in ids.select("lang").distinct().collect())  # one name a language
    if not languages:
        return None
    ids = ids.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = ids.select("lang", "h").withColumn("place", place).where(F.col("place") <= rows)
    # at most `rows` hashes a language, so this side may be broadcast
    sample = ids.join(F.broadcast(some.select("lang", "h").distinct()), ["lang", "h"], "left_semi")
    sample = sample.dropDuplicates(["lang", "h"])
    counts = fit_counts(sample).toPandas()
    index = {x: i for i, x in enumerate(languages)}
    lang = counts["lang"].map(index).to_numpy()
    return build_model(languages, lang, counts["gram"].to_numpy(), counts["n"].to_numpy().astype(float))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score. `und` and 0 if text is null or has no letter, or if nothing could be learned.

    score is the share of the winner's probability when all languages are as likely beforehand. Ties go to the first
    language by name. Columns lang_pred and score of docs, if any, are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double"
    place = names.index("text")

    def run(batches):
        for batch in batches:
            best, score = [], []
            for text in batch.column(place).to_pylist():
                if model is None or not text or not any(c.isalpha() for c in text):
                    best.append("und")
                    score.append(0.0)
                    continue
                bits = code_lengths(model, text)
                i = int(np.argmin(bits))
                best.append(model.languages[i])
                score.append(float(1.0 / np.exp2(np.maximum(bits[i] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(releasing(run), schema)


def identify(docs: DataFrame, held_out=None, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled rows of docs outside held_out (a boolean column), predict all rows."""
    labelled = docs if held_out is None else docs.where(~F.coalesce(held_out, F.lit(False)))
    return predict(docs, train(labelled, rows))
