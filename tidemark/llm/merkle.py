"""A Merkle manifest of a table: a digest of each row, a tree over each group of rows, a tree over the groups, and proofs.

Nodes are events. A task keeps partial parents, each of which gathers the digests of its children by place; how many it needs
follows from the size of its tree alone, so neither order nor neighbours matter. A parent that is complete becomes an event
of its own at once. What is still partial when the task's rows end (the frontier, a few nodes for each run of rows) is
shuffled by the block of leaves above it and combined again. Every complete parent is written as a link to its children; read
from the root down, the links give each node the siblings on its way to the root, which is its proof.
"""

from __future__ import annotations

import functools
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

ARITY = 3
#: Levels that are combined, or proved, in one shuffle: a group of that holds ARITY ** LEVELS leaves at most.
LEVELS = 7
#: Rows that a task hands on at a time.
AT_ONCE = 20_000


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values in a row: `-` for a null, else its UTF-8 bytes' count, `:` and itself."""
    text = lambda v: v.cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(text(v)).cast("string"), F.lit(":"), text(v)), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def parent_digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def level_sizes(n: int, arity: int) -> list[int]:
    """Nodes on each level of a tree over n leaves, the leaves first; the last is 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def numbered(rows: DataFrame, tree: str, order: list[str], keep: Scratch) -> DataFrame:
    """rows with _idx, their place in their tree by order (from 0), and _n, the tree's rows.

    Rows are sorted over all tasks by ranges of (tree, order), so a large tree lies in many tasks; what is gathered for each
    tree is one count for each task that it lies in. order has to tell all rows of a tree apart.
    """
    ordered = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ordered = keep(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "merkle-sorted")
    runs = ordered.groupBy(tree, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tree, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"))
    placed = ordered.join(runs, [tree, "_task"]).withColumn("_idx", F.col("_at") + F.col("_shift"))
    return keep(placed.drop("_at", "_task", "_shift"), "merkle-leaves")


_EVENT = "tree string, n long, level int, idx long, digest string, children array<string>"
_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])


def _combine(arity: int):
    """Events in, links out: a row with children is a complete parent, one without is an event whose parent is still partial."""

    def run(batches):
        sizes: dict[int, list[int]] = {}
        partial: dict[tuple, dict[int, str]] = {}
        out: list[tuple] = []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out.clear()
            return made

        for b in batches:
            for tree, n, level, idx, made in zip(*(b.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest"))):
                size = sizes.get(n)
                if size is None:
                    size = sizes[n] = level_sizes(n, arity)
                while level + 1 < len(size):
                    parent = idx // arity
                    key = (tree, n, level, parent)
                    have = partial.setdefault(key, {})
                    have[idx] = made
                    if len(have) < min(arity, size[level] - parent * arity):
                        break
                    del partial[key]
                    children = [have[i] for i in sorted(have)]
                    level, idx, made = level + 1, parent, parent_digest(children)
                    out.append((tree, n, level, idx, made, children))
                if len(out) >= AT_ONCE:
                    yield batch()
        for (tree, n, level, _), have in partial.items():
            out.extend((tree, n, level, idx, made, None) for idx, made in have.items())
            if len(out) >= AT_ONCE:
                yield batch()
        if out:
            yield batch()

    return run


def _block(top: int, level: Column, idx: Column, arity: int) -> Column:
    """The node on level top that (level, idx) is below; what is above top stands for itself."""
    return F.floor(idx / F.pow(F.lit(float(arity)), F.greatest(F.lit(top) - level, F.lit(0)))).cast("long")


def links(leaves: DataFrame, rounds: int, keep: Scratch, arity: int = ARITY) -> DataFrame:
    """The parents of all trees (tree, level, idx, digest, children) from leaves (tree, n, idx, digest).

    rounds: shuffles, so that LEVELS * rounds covers the highest tree. The first pass shuffles nothing.
    """
    events = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    found = None
    for r in range(rounds + 1):
        if r:
            events = events.select("*", _block(LEVELS * r, F.col("level"), F.col("idx"), arity).alias("block"))
            events = events.repartition("tree", "block").drop("block")
        made = keep(events.mapInArrow(_combine(arity), _EVENT), "merkle-links")
        events = made.where("children IS NULL").drop("children")
        parents = made.where("children IS NOT NULL").drop("n")
        found = parents if found is None else found.unionByName(parents)
    return found


_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_STEPS = "array<struct<left: string, right: string>>"


def _descend(levels: int, arity: int, finish):
    """One block: a node with its path, the links below it, and what lies `levels` levels up from the leaves or is a leaf.

    A path holds, for each level from the node up, the siblings before and after it, as text.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        top = next(r for r in rows if r["path"] is not None)
        below = {(r["level"], r["idx"]): r["children"] for r in rows if r["children"] is not None}
        steps = {(top["level"], top["idx"]): [(s["left"], s["right"]) for s in top["path"]]}
        for level in range(top["level"], levels, -1):
            for (at, idx), path in [x for x in steps.items() if x[0][0] == level]:
                children = below[at, idx]
                for i in range(len(children)):
                    steps[at - 1, idx * arity + i] = [("".join(children[:i]), "".join(children[i + 1 :])), *path]
                del steps[at, idx]
        return finish(top, steps, rows, t.schema.field("id").type)

    return run


def _paths(top: dict, steps: dict, rows: list[dict], kind: pa.DataType) -> pa.Table:
    at = list(steps)
    return pa.table({
        "tree": pa.array([top["tree"]] * len(at), pa.string()),
        "level": pa.array([x[0] for x in at], pa.int32()),
        "idx": pa.array([x[1] for x in at], pa.int64()),
        "path": pa.array([[{"left": a, "right": b} for a, b in steps[x]] for x in at], pa.list_(_STEP)),
        "subroot": pa.array([top["subroot"]] * len(at), pa.string()),
    })


def _proofs(top: dict, steps: dict, rows: list[dict], kind: pa.DataType, with_proof: bool) -> pa.Table:
    ids, leaves, subroots, hashed, folds, ways = [], [], [], [], [], []
    for r in rows:
        if r["leaf"] is None:
            continue
        path = steps[0, r["idx"]]
        folded = r["tampered"]
        for left, right in path:
            folded = sha256(f"{left}{folded}{right}".encode()).hexdigest()
        ids.append(r["id"])
        leaves.append(r["leaf"])
        subroots.append(top["subroot"])
        hashed.append(parent_digest([x for step in path for x in step]))
        folds.append(folded)
        ways.append([{"left": a, "right": b} for a, b in path] if with_proof else None)
    out = {"id": pa.array(ids, kind), "leaf": leaves, "subroot": subroots, "proof_sha256": hashed, "folded_root": folds}
    return pa.table(out | {"proof": pa.array(ways, pa.list_(_STEP))})


def _side(df: DataFrame, id_type: str, **given: Column) -> DataFrame:
    """df in the shape that all rows of a block share."""
    kinds = {"tree": "string", "level": "int", "idx": "long", "children": "array<string>", "path": _STEPS, "subroot": "string", "id": id_type, "leaf": "string", "tampered": "string"}
    return df.select([given.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def proofs(parents: DataFrame, tops: DataFrame, rounds: int, keep: Scratch, leaves: DataFrame | None = None, arity: int = ARITY, with_proof: bool = False) -> DataFrame:
    """Walk the links from each tree's top (tree, level, idx, path, subroot) down to its leaves, LEVELS levels a shuffle.

    With leaves (tree, idx, id, leaf, tampered): (id, leaf, subroot, proof_sha256, folded_root, proof) for each; without, each
    leaf's (tree, level, idx, path, subroot).
    """
    c = F.col
    kind = leaves.schema["id"].dataType.simpleString() if leaves is not None else "long"
    for r in range(max(rounds, 1) - 1, -1, -1):
        low, high = LEVELS * r, LEVELS * (r + 1)
        # what is no higher than this round's floor waits for the next
        here = _side(tops.where(c("level") > low) if r else tops, kind, **{x: c(x) for x in tops.columns})
        step = parents.where(c("level").between(low + 1, high)).drop("digest")
        here = here.unionByName(_side(step, kind, **{x: c(x) for x in step.columns}))
        if r == 0 and leaves is not None:
            here = here.unionByName(_side(leaves, kind, level=F.lit(0), **{x: c(x) for x in leaves.columns}))
        here = here.withColumn("block", _block(high, c("level"), c("idx"), arity)).groupBy("tree", "block")
        if r == 0 and leaves is not None:
            return here.applyInArrow(_descend(0, arity, functools.partial(_proofs, with_proof=with_proof)), f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, proof {_STEPS}")
        out = keep(here.applyInArrow(_descend(low, arity, _paths), f"tree string, level int, idx long, path {_STEPS}, subroot string"), "merkle-paths")
        tops = tops.where(c("level") <= low).unionByName(out) if r else out
    return tops


def manifest(rows: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column] | None = None, arity: int = ARITY, with_proof: bool = False) -> DataFrame:
    """rows' order column with leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of the table and a check of it.

    A leaf is the digest of fields. Leaves of one value of group make a tree by ascending order (null first, then equal
    ones by their leaf, then as they lie); every `arity` consecutive nodes of a level become one, up to the subroot. Subroots
    by group (null first, then by UTF-8 bytes) make the tree of the root likewise. proof_sha256 is the digest of all siblings
    on the way to the root, level by level, left to right. folded_root is what the leaf of the tampered row (columns that
    tampered replaces; without it the row itself) and the proof give; verified tells whether that is the root.

    with_proof adds proof, an array with the digests before and after the node on each level of the way, which `fold` can check
    against any row later; that is some 100 bytes a level and row.

    Repeated rows are leaves of their own. An empty table gives no rows. Other columns are ignored, so their names can't clash.
    Texts are read once and not shuffled: digests are.
    """
    changed = {f: (tampered or {}).get(f, F.col(f)) for f in fields}
    keep, c = Scratch(), F.col
    rounds = lambda n: -(-(len(level_sizes(n, arity)) - 1) // LEVELS)
    key = F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit(""))  # not null, in the same order
    base = rows.select(key.alias("tree"), c(order).alias("id"), digest(*map(F.col, fields)).alias("leaf"), digest(*changed.values()).alias("tampered"))
    base = keep(base, "merkle-digests").withColumn("_row", F.monotonically_increasing_id())
    leaves = numbered(base, "tree", ["id", "leaf", "_row"], keep)
    most, count = leaves.groupBy("tree").agg(F.max("_n").alias("n")).agg(F.max("n"), F.count("*")).first()
    result = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not count:
        result += f", proof {_STEPS}" if with_proof else ""
        return rows.sparkSession.createDataFrame([], f"`{order}` {leaves.schema['id'].dataType.simpleString()}, {result}")
    parents = links(leaves.select("tree", c("_n").alias("n"), c("_idx").alias("idx"), c("leaf").alias("digest")), rounds(most), keep, arity)
    # a tree's root is the highest of its first nodes
    first = leaves.where("_idx = 0").select("tree", F.lit(0).alias("level"), c("leaf").alias("digest"))
    first = first.unionByName(parents.where("idx = 0").select("tree", "level", "digest"))
    roots = first.groupBy("tree").agg(F.max_by("digest", "level").alias("subroot"), F.max("level").alias("level"))
    upper = numbered(roots.select(F.lit("").alias("all"), "tree", "subroot", "level"), "all", ["tree"], keep)
    events = upper.select(c("all").alias("tree"), c("_n").alias("n"), c("_idx").alias("idx"), c("subroot").alias("digest"))
    over = links(events, rounds(count), keep, arity)
    height = len(level_sizes(count, arity)) - 1
    root = (over.where(c("level") == height) if height else events).select("digest").first()[0]
    start = rows.sparkSession.range(1).select(
        F.lit("").alias("tree"), F.lit(height).alias("level"), F.lit(0).cast("long").alias("idx"), F.array().cast(_STEPS).alias("path"), F.lit(None).cast("string").alias("subroot"),
    )
    paths = proofs(over, start, rounds(count), keep, arity=arity).select(c("idx").alias("_idx"), "path")
    tops = keep(upper.join(paths, "_idx").select("tree", "level", F.lit(0).cast("long").alias("idx"), "path", "subroot"), "merkle-tops")
    ends = leaves.select("tree", c("_idx").alias("idx"), "id", "leaf", "tampered")
    out = materialize(proofs(parents, tops, rounds(most), keep, ends, arity, with_proof), "merkle-proofs")
    keep.clear(rows.sparkSession)
    out = out.select(c("id").alias(order), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (c("folded_root") == F.lit(root)).alias("verified"), "proof")
    return out if with_proof else out.drop("proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give, by Spark's functions alone: a row is in the manifest if that is the root."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step.left, h, step.right), 256))
