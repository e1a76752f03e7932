"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Largest inner product is turned into least distance by one more coordinate, sqrt(R^2 - |x|^2), which makes all vectors of
a shard equally long. A shard's graph is flat arrays: neighbours of layer l are a matrix of places, -1 where there is none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, finite_vector, materialize, spread

#: Vectors of a shard and queries of a block; links that a node makes (it may hold twice as many); nodes
#: looked at when links are chosen; candidates kept while searching; nodes that come in together.
SHARD, QUERIES, M, BUILD, SEARCH, GROUP = 8192, 512, 16, 64, 128, 256
_STEP = 4


def _augmented(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(sq.max(initial=0.0) - sq, 0.0))[:, None]], axis=1).astype(np.float32)


def _spread(near: np.ndarray, d: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Of each row's nodes (places in x, nearest first, -1 at the end), at most m: those nearer to the row's own node than to any
    kept before, then the nearest ones passed by. The same shape, -1 where there is none."""
    there = near >= 0
    v = x[near]
    between = -(v @ v.transpose(0, 2, 1))
    keep = np.zeros(near.shape, bool)
    for i in range(near.shape[1]):
        blocked = (keep[:, :i] & (between[:, i, :i] < d[:, i, None])).any(axis=1)
        keep[:, i] = there[:, i] & ~blocked & (keep.sum(axis=1) < m)
    passed = there & ~keep
    keep |= passed & (passed.cumsum(axis=1) <= (m - keep.sum(axis=1))[:, None])
    return np.where(keep, near, -1)


def _left(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row's nodes moved to the left, in their order, and the row cut or filled up to a width."""
    out = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), axis=1)[:, :width]
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)


def _link(links: np.ndarray, x: np.ndarray, new: np.ndarray, near: np.ndarray, d: np.ndarray, m: int) -> None:
    """Link new nodes with m of those found for them, both ways; a node with more than 2 m links keeps those that point apart."""
    chosen = _spread(near, d, x, m)
    links[new] = _left(chosen, links.shape[1])
    r, c = np.nonzero(chosen >= 0)
    src, dst, far = chosen[r, c], new[r], d[r, c]
    order = np.lexsort((far, src))
    src, dst, far = src[order], dst[order], far[order]
    ends, first = np.unique(src, return_index=True)
    rank = np.arange(len(src)) - first[np.searchsorted(ends, src)]
    ok = rank < links.shape[1]  # no more than these could stay
    back = np.full((len(ends), links.shape[1]), -1, np.int32)
    back[np.searchsorted(ends, src[ok]), rank[ok]] = dst[ok]
    all_ = np.concatenate([links[ends], back], axis=1)
    all_.sort(axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1  # two new nodes may have chosen each other
    many = (all_ >= 0).sum(axis=1) > links.shape[1]
    links[ends[~many]] = _left(all_[~many], links.shape[1])
    e, rows = ends[many], all_[many]
    dist = np.where(rows >= 0, -np.einsum("rcd,rd->rc", x[rows], x[e]), np.inf)
    near_ = np.argsort(dist, axis=1, kind="stable")
    rows, dist = np.take_along_axis(rows, near_, axis=1), np.take_along_axis(dist, near_, axis=1)
    links[e] = _left(_spread(rows, dist, x, links.shape[1]), links.shape[1])


class Graph:
    """Layers from the top: (nodes, links); nodes are places in x, links are places in x too."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, seed: int = 0) -> Graph:
        """Nodes come in by searching the graph of those before them, the highest ones first, in groups that grow with the graph;
        the members of a group are held against each other directly."""
        x = _augmented(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / np.log(m)).astype(int)
        order = np.argsort(-level, kind="stable")
        x_, level = x[order], level[order]
        top = int(level[0]) if len(x) else 0
        sizes = [int((level >= l).sum()) for l in range(top, -1, -1)]
        g = cls(x_, [(np.arange(n, dtype=np.int32), np.full((n, 2 * m), -1, np.int32)) for n in sizes])
        at = 1
        while at < len(x):
            end = min(at + min(at, GROUP), next(n for n in sizes if n > at))
            new = np.arange(at, end)
            q, entry = x_[new], np.zeros((len(new), 1), np.int32)
            own = -(q @ q.T)
            own[np.arange(len(new)), np.arange(len(new))] = np.inf
            for (nodes, links), n in zip(g.layers, sizes):
                met = g._layer(q, entry, nodes, links, 1 if n <= at else BUILD)
                entry = met[:, :1]
                if n > at:
                    d = np.where(met >= 0, -np.einsum("qnd,qd->qn", x_[met], q), np.inf)
                    near, d = np.concatenate([met, np.broadcast_to(new, own.shape)], axis=1), np.concatenate([d, own], axis=1)
                    best = np.argsort(d, axis=1, kind="stable")[:, :BUILD]
                    near, d = np.take_along_axis(near, best, axis=1), np.take_along_axis(d, best, axis=1)
                    _link(links, x_, new, np.where(np.isfinite(d), near, -1).astype(np.int32), d, m)
            at = end
        return cls(x, [(order[n].astype(np.int32), np.where(l >= 0, order[l], -1).astype(np.int32)) for n, l in g.layers])

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Places of about the ef nearest nodes of each query (columns; -1 where fewer were met), nearest first."""
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        entry = np.repeat(self.layers[0][0][:1], len(q))[:, None]
        for nodes, links in self.layers[:-1]:
            entry = self._layer(q, entry, nodes, links, 1)
        return self._layer(q, entry, *self.layers[-1], ef)

    def _layer(self, q: np.ndarray, entry: np.ndarray, nodes: np.ndarray, links: np.ndarray, ef: int) -> np.ndarray:
        """All queries walk in step: each round opens the best nodes not yet opened, and keeps the ef nearest met so far."""
        place = np.full(len(self.x) + 1, -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        rows = np.arange(len(q))
        met = np.zeros((len(q), len(self.x) + 1), bool)
        met[:, -1] = True  # -1: no node
        best = np.full((len(q), ef), -1, np.int32)
        far = np.full((len(q), ef), np.inf, np.float32)
        opened = np.ones((len(q), ef), bool)
        best[:, 0], far[:, 0], opened[:, 0] = entry[:, 0], -(self.x[entry[:, 0]] * q).sum(axis=1), False
        met[rows, entry[:, 0]] = True
        step = min(_STEP, ef)
        live = rows
        while len(live):
            todo = np.where(opened[live], np.inf, far[live])
            pick = np.argsort(todo, axis=1, kind="stable")[:, :step]
            valid = np.isfinite(np.take_along_axis(todo, pick, axis=1))
            live, pick, valid = (v[valid[:, 0]] for v in (live, pick, valid))
            if not len(live):
                break
            r = np.broadcast_to(live[:, None], pick.shape)
            opened[r[valid], pick[valid]] = True
            at = np.where(valid, best[r, pick], -1)
            next_ = np.where(at[:, :, None] >= 0, links[place[at]], -1).reshape(len(live), -1)
            next_ = np.where(met[live[:, None], next_], -1, next_)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            met[live[:, None], next_] = True
            d = -np.einsum("qnd,qd->qn", self.x[next_], q[live])
            d[next_ < 0] = np.inf
            d_all, n_all = np.concatenate([far[live], d], axis=1), np.concatenate([best[live], next_], axis=1)
            o_all = np.concatenate([opened[live], next_ < 0], axis=1)
            keep = np.argsort(d_all, axis=1)[:, :ef]
            far[live], best[live], opened[live] = (np.take_along_axis(v, keep, axis=1) for v in (d_all, n_all, o_all))
        return np.where(np.isfinite(far), best, -1)


def _floats(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


_INDEX = "shard int, vids binary, starts binary, vectors binary, dim int, nodes array<binary>, links array<binary>"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, m: int = M) -> DataFrame:
    """One row per shard and length of vectors: distinct vectors, the ids of each (starts: where they begin), and the layers of the graph."""
    held = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).cast("array<double>").alias("vec")).where("vid IS NOT NULL")
    held = held.where(usable("vec"))
    rows = held.withColumn("shard", spread(blocks(held.count(), shard))).withColumn("dim", F.size("vec"))

    def run(key, t):
        vid, x = t.column("vid").to_numpy(), _floats(t.column("vec"))
        x, inverse = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((vid, inverse.ravel()))
        starts = np.searchsorted(inverse.ravel()[order], np.arange(len(x) + 1))
        g = Graph.build(x, m)
        row = {
            "shard": [key[0].as_py()], "vids": [vid[order].astype("<i8").tobytes()], "starts": [starts.astype("<i8").tobytes()],
            "vectors": [x.tobytes()], "dim": [x.shape[1]], "nodes": [[n.tobytes() for n, _ in g.layers]], "links": [[l.tobytes() for _, l in g.layers]],
        }
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("vids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    return rows.groupBy("shard", "dim").applyInArrow(run, _INDEX)


def usable(name: str):
    """Neither null nor zero nor holding a null or non-finite component."""
    return finite_vector(name) & F.exists(F.col(name), lambda x: x != 0)


def search_index(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = SEARCH, m: int = M, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) over all shards of an index that has been written."""
    asked = queries.select(F.col(id_col).cast("long").alias("vid"), F.col(vec_col).cast("array<double>").alias("vec")).where("vid IS NOT NULL")
    asked = materialize(asked.where(usable("vec")).withColumn("qkey", F.monotonically_increasing_id()), "queries")
    shards, nq = (index.agg(F.max("shard")).first()[0] or 0) + 1, blocks(asked.count(), block)
    right = asked.withColumn("qb", F.pmod(F.xxhash64("qkey"), F.lit(nq)).cast("int")).groupBy("qb", F.size("vec").alias("dim")).agg(F.collect_list(F.struct("qkey", "vid", "vec")).alias("rows"))
    left = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(key, a, b):
        out = {"qkey": [], "query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            row = a.to_pylist()[0]
            vids, starts = np.frombuffer(row["vids"], "<i8"), np.frombuffer(row["starts"], "<i8")
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            links = [np.frombuffer(l, np.int32).reshape(-1, 2 * m) for l in row["links"]]
            g = Graph(_augmented(x), [(np.frombuffer(n, np.int32), l) for n, l in zip(row["nodes"], links)])
            s = b.column("rows").combine_chunks().flatten()
            qkey, qid, q = np.asarray(s.field(0)), np.asarray(s.field(1)), _floats(s.field(2))
            found = g.search(q, max(ef, k + 1))
            for i in range(len(q)):
                f = found[i][found[i] >= 0]
                score = (x[f] * q[i]).sum(axis=1)  # in double, the same way for every row: equal vectors tie exactly
                f, score = f[np.argsort(-score, kind="stable")][: k + 1], np.sort(-score, kind="stable")[: k + 1] * -1
                for j, v in zip(f, score):
                    ids = vids[starts[j] : starts[j + 1]]
                    ids = ids[ids != qid[i]][:k]  # by id: of equal vectors no more than k can count
                    for name, c in (("qkey", np.full(len(ids), qkey[i])), ("query_id", np.full(len(ids), qid[i])), ("vec_id", ids), ("score", np.full(len(ids), v))):
                        out[name].append(c)
        kinds = {"qkey": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()})

    found = left.groupBy("shard", "dim", "qb").cogroup(right.groupBy("shard", "dim", "qb")).applyInArrow(run, "qkey long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found by largest inner product, ties to smaller id; rows with the query's id are left out.

    Rows whose id is null, or whose vector is null, zero or holds a null or non-finite component, take no part. Repeated
    candidate rows count as often as they occur, repeated query rows are answered each time. A query only
    finds vectors of its own length. Empty tables give no rows. Every row is indexed;
    equal vectors of a shard are one node, so copies, however many, neither crowd the graph nor hide others.
    """
    index = materialize(build_index(candidates, id_col, vec_col), "shards")
    return search_index(index, queries, k, id_col, vec_col)
