"""Exact top-k search by inner product: distributed histogram selection.

Every pass scores all (query, candidate) pairs in blocks and keeps, for each query, only counts of scores by bin. A few
passes narrow each query's bin down to one score, the k-th. The last pass returns what lies above it and the ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, finite_vector, materialize, spread

#: Bins of one pass; rows of a candidate block and of a query block (block pairs are the unit of work).
BINS, CANDIDATES, QUERIES = 512, 4096, 512
#: What a long holds.
LIMIT = (1 << 63) - 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one block; shorter ones are padded with zeros, which add nothing to an inner product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Integer inner products, of no meaning where own. Doubles hold them exactly below 2^53; beyond that Python's integers do the sums."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1)
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda x: np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    scores = np.where(own, 0, whole(q) @ whole(c).T)
    if scores.size and max(scores.max(), -scores.min()) > LIMIT:
        raise OverflowError("an inner product doesn't fit a long")
    return scores.astype(np.int64)


def _unpack(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The scalar fields and the matrix of a block, which is one row holding a list of structs."""
    rows = t.column("rows").combine_chunks().flatten()
    fields = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    vectors = _matrix(fields.pop("vec"))
    return [np.asarray(x) for x in fields.values()], vectors


def _histogram(k: int, step: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qkey": [], "bin": [], "n": []}
        if left.num_rows and right.num_rows:
            (cid,), c = _unpack(left)
            (qkey, qid, lo), q = _unpack(right)
            scores = _scores(q, c, qid[:, None] == cid[None, :])
            for i in range(len(qkey)):
                s = scores[i][cid != qid[i]]
                s = s[s >= lo[i]]  # below the kept range: of no use; above: counted in an earlier pass
                bins = (s.view(np.uint64) - np.int64(lo[i]).view(np.uint64)) // np.uint64(step)  # a difference may be beyond a long
                found, n = np.unique(bins[bins < BINS].astype(np.int64), return_counts=True)
                found, n = found[::-1], n[::-1]
                above = np.cumsum(n) - n
                keep = above < k  # the block's own k-th score lies in its last kept bin; what is lower can't be needed
                out["qkey"].append(np.full(keep.sum(), qkey[i]))
                out["bin"].append(found[keep])
                out["n"].append(n[keep])
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0), pa.int64()) for n, v in out.items()})

    return run


def _select(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qkey": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            (cid,), c = _unpack(left)
            (qkey, qid, lo), q = _unpack(right)
            order = np.argsort(cid, kind="stable")
            cid, c = cid[order], c[order]
            scores = _scores(q, c, qid[:, None] == cid[None, :])
            for i in range(len(qkey)):
                s, own = scores[i], cid == qid[i]
                ties = np.flatnonzero((s == lo[i]) & ~own)[:k]  # by vec_id: no more than k of a block's ties can count
                take = np.concatenate([np.flatnonzero((s > lo[i]) & ~own), ties])
                for name, v in (("qkey", np.full(len(take), qkey[i])), ("query_id", np.full(len(take), qid[i])), ("vec_id", cid[take]), ("score", s[take])):
                    out[name].append(v)
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0), pa.int64()) for n, v in out.items()})

    return run


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, ties to smaller vec_id.

    Components are floor(256 * x) in double precision. Rows whose id is null, or whose vector is null or holds a null or
    non-finite component, take no part. A candidate with the query's id is the query's own and is left out. A repeated
    candidate row counts as often as it occurs; a repeated query row is answered each time. Vectors of unequal length
    are compared on what they share. A score beyond a long raises OverflowError. Empty tables give no rows. Other columns are ignored.
    """
    def held(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).alias("raw"))
        df = df.where(F.col("vid").isNotNull() & finite_vector("raw"))
        # kept as doubles: doubles from 2^52 on are whole already
        level = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
        return df.select("vid", F.transform("raw", lambda x: level(x.cast("double") * 256)).alias("vec"))

    c = held(candidates)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    facts = c.agg(F.count("*"), F.max(norm)).first()
    q = materialize(held(queries).withColumn("qkey", F.monotonically_increasing_id()), "queries")
    asked = q.agg(F.count("*"), F.max(norm)).first()
    spark = c.sparkSession
    if not facts[0] or not asked[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    nc, nq = blocks(facts[0], CANDIDATES), blocks(asked[0], QUERIES)
    packed = c.withColumn("cb", spread(nc)).groupBy("cb").agg(F.collect_list(F.struct("vid", "vec")).alias("rows"))
    packed = materialize(packed, "blocks").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qkey"), F.lit(nq)).cast("int"))

    def pairs(state: DataFrame):
        """Candidate blocks beside query blocks; state has lo of each query."""
        right = q.join(state, "qkey").groupBy("qb").agg(F.collect_list(F.struct("qkey", "vid", "lo", "vec")).alias("rows"))
        right = right.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
        return packed.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb"))

    most = facts[1] * asked[1]
    bound = int(most) + 2 if most < LIMIT // 2 else LIMIT  # no inner product is larger than the product of the norms
    step = 1
    while step * BINS < 2 * bound + 1:
        step *= BINS
    state = q.select("qkey", F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    while True:
        counts = pairs(state).applyInArrow(_histogram(k, step), "qkey long, bin long, n long").groupBy("qkey", "bin").agg(F.sum("n").alias("n"))
        down = counts.withColumn("cum", F.sum("n").over(Window.partitionBy("qkey").orderBy(F.desc("bin"))))
        # the highest bin at which the count from above reaches what is needed; if none does, the lowest edge: take all
        hit = down.join(state.select("qkey", "need"), "qkey").where("cum >= need").groupBy("qkey").agg(F.max(F.struct("bin", "cum", "n")).alias("h"))
        state = state.join(hit, "qkey", "left").select(
            "qkey",
            F.when(F.col("h").isNotNull(), (F.col("lo").cast("decimal(38,0)") + F.col("h.bin").cast("decimal(4,0)") * F.lit(str(step)).cast("decimal(20,0)")).cast("long")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("h").isNotNull(), F.col("need") - F.col("h.cum") + F.col("h.n")).otherwise(F.col("need")).alias("need"),
        )
        state = materialize(state, "state")
        if step == 1:
            break
        step //= BINS
    found = pairs(state).applyInArrow(_select(k), "qkey long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
