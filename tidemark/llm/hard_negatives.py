"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector gets one more component, so that all of a shard are as long as its longest. An anchor gets a zero there and the same length: its
distance to a vector then falls as their inner product rises, and a window of scores is an annulus of distances around it.
A tree's node keeps how near and how far its rows lie from a vantage point, which bounds their scores for any anchor.
Nodes and rows wait in one heap, highest possible score first; nodes that lie outside the annulus never enter it. So rows come
out nearest first, and a search ends with its k-th row.

Shards are searched apart and their best rows merged; each holds its rows, whatever their labels, by their place alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, finite_vector, materialize, spread
from .exact_topk import LIMIT, _matrix, _scores

#: Rows of a shard, of a tree's leaf, and anchors that are searched for in one task.
SHARD, LEAF, QUERIES = 8192, 256, 4096

_INDEX = "shard int, ids array<long>, labels array<string>, vectors binary, kind string, tree array<array<double>>"
#: What a node holds: its range of rows, its vantage point's row, its two children (-1: a leaf), their nearest and farthest distances.
_NODE = ("start", "stop", "vantage", "near", "far", "near_lo", "near_hi", "far_lo", "far_hi")


def augmented(v: np.ndarray) -> np.ndarray:
    """Vectors with a component that makes them all as long as the longest."""
    squares = (v * v).sum(axis=1)
    rest = squares.max(initial=0.0) - squares
    return np.column_stack([v, np.sqrt(np.maximum(rest, 0.0))])


def build_tree(v: np.ndarray, leaf: int = LEAF, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): rows in the order of the leaves, and one row of _NODE for each node, parents before children.

    A node's vantage point is the row farthest from its first row; rows up to the median distance from it go to the near
    child. Rows that can't be told apart by distance stay in one leaf. Within a leaf rows lie by their ids.
    """
    x = augmented(v)
    order = np.arange(len(v))
    nodes = [[0, len(v), -1, -1, -1, 0, 0, 0, 0]]
    at = 0
    while at < len(nodes):
        start, stop = nodes[at][:2]
        rows = order[start:stop]
        if len(rows) > leaf:
            vantage = rows[np.argmax(np.linalg.norm(x[rows] - x[rows[0]], axis=1))]
            d = np.linalg.norm(x[rows] - x[vantage], axis=1)
            cut = np.median(d)
            near = d <= cut if (d > cut).any() else d < cut
            if np.isfinite(d).all() and near.any() and not near.all():
                order[start:stop] = np.concatenate([rows[near], rows[~near]])
                middle = start + int(near.sum())
                nodes[at][2:] = [vantage, len(nodes), len(nodes) + 1, d[near].min(), d[near].max(), d[~near].min(), d[~near].max()]
                nodes += [[a, b, -1, -1, -1, 0, 0, 0, 0] for a, b in ((start, middle), (middle, stop))]
        at += 1
    if ids is not None:
        for start, stop, vantage, *_ in nodes:
            if vantage < 0:
                order[start:stop] = order[start:stop][np.argsort(ids[order[start:stop]], kind="stable")]
    made = np.array(nodes, dtype=np.float64)
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    inner = made[:, 2] >= 0
    made[inner, 2] = place[made[inner, 2].astype(np.int64)]
    return order, made


class Tree:
    """One shard's rows in the order of its leaves, ready for a block of anchors."""

    def __init__(self, ids: np.ndarray, labels: list[str], v: np.ndarray, nodes: np.ndarray):
        self.ids, self.v = ids, v
        names, self.codes = np.unique(np.array(labels, dtype=object), return_inverse=True)
        self.code = {name: i for i, name in enumerate(names)}
        for i, name in enumerate(_NODE):
            setattr(self, name, nodes[:, i] if i > 4 else nodes[:, i].astype(np.int64))
        ranges = [self.codes[a:b] for a, b in zip(self.start, self.stop)]
        self.least, self.most = (np.array([f(c) if len(c) else -1 for c in ranges]) for f in (np.min, np.max))
        self.longest = (v * v).sum(axis=1).max(initial=0.0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): for each anchor and node, bounds of the scores below the node; wider than rounding could need."""
        with np.errstate(over="ignore", invalid="ignore"):
            # an anchor is made as long as the rows, which scales its scores: so its distances differ most
            length = np.sqrt((q * q).sum(axis=1))
            scale = np.where(length > 0, np.sqrt(self.longest) / np.where(length > 0, length, 1), 1)
            scale = np.where(scale > 0, scale, 1)
            reach = length * length * scale * scale + self.longest
            inner = np.flatnonzero(self.vantage >= 0)
            away = np.sqrt(np.maximum(reach[:, None] - 2 * scale[:, None] * (q @ self.v[self.vantage[inner]].T), 0.0))
            slack = 1e-9 * np.sqrt(reach) + 1e-9
            nearest, farthest = np.zeros((len(q), len(self.start))), np.full((len(q), len(self.start)), np.inf)
            for i, node in enumerate(inner):  # parents come before children
                for child, lo, hi in ((self.near[node], self.near_lo[node], self.near_hi[node]), (self.far[node], self.far_lo[node], self.far_hi[node])):
                    nearest[:, child] = np.maximum(nearest[:, node], np.maximum(away[:, i] - hi, lo - away[:, i]) - slack)
                    farthest[:, child] = np.minimum(farthest[:, node], away[:, i] + hi + slack)
            half, wide = 2 * scale[:, None], (1e-9 * reach / scale + 1)[:, None]
            high = np.nan_to_num((reach[:, None] - nearest * nearest) / half + wide, nan=np.inf, posinf=np.inf)
            low = np.nan_to_num((reach[:, None] - farthest * farthest) / half - wide, nan=-np.inf, neginf=-np.inf)
        return low, high


class Anchor:
    """Incremental search around one anchor: the leaves it has opened stay scored for its other windows."""

    def __init__(self, tree: Tree, own: int, label: str, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, exact: bool):
        self.tree, self.own, self.q, self.same, self.exact = tree, own, q, same, exact
        self.label = tree.code.get(label, -1)
        self.low, self.high = low.tolist(), high.tolist()
        alike = (tree.least == self.label) & (tree.most == self.label)
        self.useless = ((tree.least > self.label) | (tree.most < self.label) if same else alike).tolist()
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def leaf(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(negative scores, ids) of the leaf's rows that count, best first, ties to the smaller id."""
        found = self.opened.get(node)
        if found is None:
            t = self.tree
            a, b = t.start[node], t.stop[node]
            ids = t.ids[a:b]
            keep = ((t.codes[a:b] == self.label) == self.same) & (ids != self.own)
            v = t.v[a:b]
            s = (v @ self.q).astype(np.int64) if self.exact else _scores(self.q[None], v, np.zeros((1, b - a), bool))[0]
            s, ids = -s[keep], ids[keep]
            order = np.argsort(s, kind="stable")  # a leaf's rows lie by id
            found = self.opened[node] = (s[order], ids[order])
        return found

    def nearest(self, lo: int, hi: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k nearest rows within the annulus lo <= score <= hi, nearest first."""
        t, out = self.tree, []
        if lo > hi or not len(t.ids):
            return out
        heap = [] if self.useless[0] else [(-self.high[0], 0, 0)]
        while heap and len(out) < k:
            value, is_row, x, *leaf = heapq.heappop(heap)
            if is_row:
                out.append((x, -value))
                node, at = leaf
                s, ids = self.opened[node]
                if at + 1 < len(s) and s[at + 1] <= -lo:  # of a leaf, one row waits at a time
                    heapq.heappush(heap, (int(s[at + 1]), 1, int(ids[at + 1]), node, at + 1))
            elif t.near[x] >= 0:
                for child in (int(t.near[x]), int(t.far[x])):
                    if self.high[child] >= lo and self.low[child] <= hi and not self.useless[child]:
                        heapq.heappush(heap, (-self.high[child], 0, child))
            else:
                s, ids = self.leaf(x)
                at = int(s.searchsorted(-hi))
                if at < len(s) and s[at] <= -lo:
                    heapq.heappush(heap, (int(s[at]), 1, int(ids[at]), x, at))
        return out


def _index(leaf: int):
    def run(t: pa.Table) -> pa.Table:
        v = _matrix(t.column("vec"))
        order, nodes = build_tree(v, leaf, t.column("vid").to_numpy())
        kind = next((k for k in ("<i2", "<i4") if np.abs(v).max(initial=0) <= np.iinfo(k).max), "<f8")
        t = t.take(pa.array(order))
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()], pa.int32()),
            "ids": pa.array([t.column("vid").to_pylist()], pa.list_(pa.int64())),
            "labels": pa.array([t.column("label").to_pylist()], pa.list_(pa.string())),
            "vectors": pa.array([v[order].astype(kind).tobytes()], pa.binary()),
            "kind": pa.array([kind]),
            "tree": pa.array([nodes.tolist()], pa.list_(pa.list_(pa.float64()))),
        })

    return run


def held(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vid, label, vec): the rows that take part; components are floor(256 * x), kept as whole doubles."""
    df = df.select(F.col(id_col).cast("long").alias("vid"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("raw"))
    df = df.where(F.col("vid").isNotNull() & F.col("label").isNotNull() & finite_vector("raw"))
    level = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return df.select("vid", "label", F.transform("raw", lambda x: level(x.cast("double") * 256)).alias("vec"))


def build_index(rows: DataFrame, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """One row for each shard of rows (vid, label, vec): its ids, labels and vectors by leaf, and its tree."""
    n = blocks(rows.count(), shard)
    return rows.withColumn("shard", spread(n)).groupBy("shard").applyInArrow(_index(leaf), _INDEX)


def search(index: DataFrame, asked: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """(qkey, wkey, vec_id, score): k nearest rows of each shard, for each window of each query.

    asked: (qkey, vid, label, vec, windows array<struct<wkey, score>>). A null score leaves the window open; others ask for
    scores from low to high percent of it. same: rows of the query's own label, else of others. Rows of the query's id never count.
    """
    counts = asked.count()
    shards = index.count()
    nq = blocks(counts, QUERIES)
    left = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("qkey"), F.lit(nq)).cast("int"))
    right = right.groupBy("qb").agg(F.collect_list(F.struct("qkey", "vid", "label", "vec", "windows")).alias("rows"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))

    def run(trees: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and block.num_rows:
            (t,) = trees.to_pylist()
            rows = block.column("rows").combine_chunks().flatten()
            q, plain = _matrix(rows.field(3)), [rows.field(i).to_pylist() for i in (0, 1, 2, 4)]
            v = np.frombuffer(t["vectors"], t["kind"]).reshape(len(t["ids"]), -1).astype(np.float64)
            width = max(q.shape[1], v.shape[1])
            q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
            exact = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(width, 1) < 2.0**53
            tree = Tree(np.array(t["ids"], np.int64), t["labels"], v, np.array(t["tree"]))
            for a in range(0, len(q), 256):
                lows, highs = tree.bounds(q[a : a + 256])
                for i in range(a, min(a + 256, len(q))):
                    anchor = Anchor(tree, plain[1][i], plain[2][i], q[i], lows[i - a], highs[i - a], same, exact)
                    done: dict = {}
                    for w in plain[3][i]:
                        score = w["score"]
                        if score not in done:
                            span = (-LIMIT - 1, LIMIT) if score is None else (-(-low * score // 100), high * score // 100)
                            done[score] = anchor.nearest(*span, k)
                        out += [(plain[0][i], w["wkey"], x, s) for x, s in done[score]]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("qkey", "wkey", "vec_id", "score"), cols)})

    return left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(run, "qkey long, wkey long, vec_id long, score long")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of components floor(256 * x), x as double; higher ones come first, ties by smaller
    id. An anchor's positives are its first `positives` rows of its label (all, if fewer). For each anchor and positive, the
    first k rows of other labels with low % <= score / positive's score <= high % come back, ranked from 1; a positive with a negative score has none.

    Rows with a null id or label, or a vector that is null or holds a null or non-finite component, take no part. Rows of
    the anchor's id are its own and left out. Repeated rows count as often as they occur, repeated anchors are answered each
    time. Vectors of unequal length are compared on what they share. A score beyond a long raises OverflowError. Empty tables
    give no rows. Other columns are ignored. No label or anchor is ever a key that rows are gathered by, but for the
    few best of each shard.
    """
    keep = Scratch()
    c = F.col
    index = keep(build_index(held(rows, id_col, vec_col, label_col), shard, leaf), "vp-index")
    asked = keep(held(anchors, id_col, vec_col, label_col).withColumn("qkey", F.monotonically_increasing_id()), "vp-anchors")
    open_window = F.array(F.struct(F.lit(0).cast("long").alias("wkey"), F.lit(None).cast("long").alias("score")))

    def best(found: DataFrame, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("qkey", "wkey").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(c("rank") <= n)

    found = search(index, asked.withColumn("windows", open_window), True, positives, low, high)
    chosen = keep(best(found, positives).select("qkey", c("rank").cast("long").alias("wkey"), c("vec_id").alias("positive_id"), c("score").alias("positive_score")), "vp-positives")
    windows = chosen.groupBy("qkey").agg(F.collect_list(F.struct("wkey", c("positive_score").alias("score"))).alias("windows"))
    found = best(search(index, asked.join(windows, "qkey"), False, k, low, high), k)
    out = found.join(chosen, ["qkey", "wkey"]).join(asked.select("qkey", c("vid").alias("anchor_id")), "qkey")
    out = materialize(out.select("anchor_id", "positive_id", c("rank").cast("int").alias("rank"), c("vec_id").alias("negative_id"), "positive_score", c("score").alias("negative_score")), "hard-negatives")
    keep.clear(rows.sparkSession)
    return out
