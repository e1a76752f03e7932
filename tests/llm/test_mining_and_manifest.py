import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, merkle, token_counts
from tidemark.llm.packing import tokenizer_path

# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["", " ", "\n\n  x", "<|endoftext|> a<|endoftext|><|endoftext|>b", "<|endoftext|", "don't I'LL 's", "a" * 70_000, "\x1c\x1d ²③ Ⅷ ٣", "🙂🙂" * 50, "é ñ ß", "x y　z", "\x00\x01"]


def test_tokens_as_the_library_counts_them(spark, sf, library):
    rng = random.Random(5)
    draw = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x1F300, 0x1F700), 32, 10]))
    texts = ODD + ["".join(draw() for _ in range(rng.randrange(80))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rows = docs.collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.count_tokens(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and {r.over_limit for r in got} == {True, False}


def test_token_rows_of_any_kind(spark):
    rows = [(None, "a b", 1), ("x", None, 2), ("x", None, 2), ("y", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, limit=1).collect())
    assert got == [("None", 3, 2, True), ("x", 0, 0, False), ("x", 0, 0, False), ("y", 0, 0, False)]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_merges_by_rank_then_place():
    # (1 1) has the lowest rank: aaa -> (aa) a, never a (aa)
    assert token_counts.count_merged([1, 1, 1], {(1, 1): (0, 2), (2, 1): (1, 3)}) == 1
    assert token_counts.count_merged([1, 1, 1], {(1, 1): (0, 2), (1, 2): (1, 3)}) == 2
    # a pair that was queued goes stale when a lower one takes its letter
    assert token_counts.count_merged([1, 2, 3], {(1, 2): (5, 4), (2, 3): (1, 6)}) == 2
    assert token_counts.count_merged([], {}) == 0


def test_forgotten_words_are_counted_again(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 2000)
    count = token_counts._Counter(tokenizer_path())
    text = " ".join(f"word{i} again" for i in range(500))
    assert count(text) == len(library.encode(text).ids) and len(count.new) + len(count.old) < 30


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# --- Merkle manifest


def H(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def J(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([J(out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(tree, i, arity):
    """(before, after) on each level of the way up from leaf i."""
    out = []
    for nodes in tree[:-1]:
        a = i - i % arity
        out.append((nodes[a:i], nodes[i + 1 : a + arity]))
        i //= arity
    return out


def brute(rows, arity=3):
    """rows (doc_id, source, text, tampered text), ids all different within a source."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([H(r[0], s, r[2]) for r in by[s]], arity) for s in sources}
    top = levels([trees[s][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = way(trees[s], i, arity) + way(top, k, arity)
            folded = H(r[0], s, r[3])
            for a, b in path:
                folded = J([*a, folded, *b])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], J([x for step in path for side in step for x in side]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity,levels_at_once", [(3, 7), (3, 2), (2, 3), (5, 1)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, levels_at_once):
    monkeypatch.setattr(merkle, "LEVELS", levels_at_once)
    rng = random.Random(arity)
    rows, sizes = [], {"hot": 400, None: 10, "": 1, "one": 1, "Z": 27, "a": 28, "ü": 3, **{f"s{i}": i % 5 + 1 for i in range(20)}}
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["", None, "line\nline\n", "täxt", "x" * 1000])
            rows.append((len(rows), s, text, text and text.replace("\n", "")))
    rows[0] = (None, "hot", "no id\n", "no id")
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, leaf string").repartition(5)
    cut = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    proved = merkle.manifest(docs, ["doc_id", "source", "text"], "source", "doc_id", cut, arity, with_proof=True).cache()
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s.left, s.right)), "")
    assert proved.where((merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")) | (F.sha2(siblings, 256) != F.col("proof_sha256"))).count() == 0
    wrong = merkle.fold(F.sha2("leaf", 256), F.col("proof"))
    assert proved.where(wrong == F.col("root")).count() == 0
    got = proved.drop("proof")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, arity)


def test_manifest_of_repeats_one_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "t")] * 40 + [(None, None, None)] * 9, "doc_id long, source string, text string")
    got = merkle.manifest(docs, ["doc_id", "source", "text"], "source", "doc_id").collect()
    assert len(got) == 49 and all(r.verified for r in got) and len({r.root for r in got}) == 1
    (one,) = merkle.manifest(docs.limit(1), ["doc_id", "source", "text"], "source", "doc_id").collect()
    assert one.root == one.subroot == one.leaf == one.folded_root == H(1, "a", "t") and one.proof_sha256 == J([])
    assert merkle.manifest(docs.limit(0), ["doc_id", "source", "text"], "source", "doc_id").count() == 0


def test_events_resolve_in_any_order():
    """A task that has all of a tree resolves it whatever the order; with a part, it hands on only what is partial."""
    import pyarrow as pa

    def run(rows):
        b = pa.RecordBatch.from_pylist([{"tree": "t", "n": 100, "level": 0, "idx": i, "digest": f"{i}"} for i in rows], pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())]))
        return [r for x in merkle._combine(3)([b]) for r in x.to_pylist()]

    order = list(range(100))
    random.Random(1).shuffle(order)
    made = run(order)
    tree = levels([str(i) for i in range(100)], 3)
    assert all(r["children"] for r in made) and len(made) == sum(map(len, tree[1:]))
    assert all(r["digest"] == tree[r["level"]][r["idx"]] for r in made)
    part = run(range(1, 55))
    assert len([r for r in part if not r["children"]]) <= 2 * 2 * 5


# --- hard negatives


def mined(rows, anchors, positives, k, low=30, high=90):
    good = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, v, l in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in good:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in good if i != a)
        for s, p, l in [x for x in scored if x[2] == label][:positives]:
            found = [(i, -t) for t, i, m in scored if m != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, n + 1, i, -s, t) for n, (i, t) in enumerate(found)]
    return sorted(out)


def vectors(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)) * rng.uniform(0.2, 3, size=(n, 1))
    v[n // 2 : n // 2 + n // 5] = v[0]  # many copies, with all labels
    return [(int(i), [float(np.float32(x)) for x in row], int(rng.integers(labels))) for i, row in enumerate(v)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("width,shard", [(2, 64), (3, 100), (24, 4096)])
def test_hard_negatives_equal_brute_force(spark, width, shard):
    rows = vectors(600, width, width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.hard_negatives(df, df.where("vec_id % 20 = 0"), 3, 4, shard=shard, leaf=8)
    assert sorted(map(tuple, got.collect())) == mined(rows, set(range(0, 600, 20)), 3, 4) != []


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(120, 3, 9)
    rows += rows[10:30:5] * 2 + [(200, None, 1), (None, [1.0, 1.0, 1.0], 1), (201, [1.0, None, 2.0], 1), (202, [float("nan"), 1.0, 1.0], 1), (203, [1.0, 1.0, 1.0], None), (204, [float("inf")], 2), (205, [], 1), (206, [2.0], 3), (100, [5.0, 5.0, 5.0, 5.0], 1)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", score int, qkey int")
    got = hard_negatives.hard_negatives(df, df.where("vec_id % 10 = 0 OR vec_id > 199"), 3, 4, shard=40, leaf=4)
    want = mined(rows, {r[0] for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 199)}, 3, 4)
    assert sorted(map(tuple, got.collect())) == want != []
    none = df.limit(0)
    assert hard_negatives.hard_negatives(none, none).count() == 0 and hard_negatives.hard_negatives(df, none).count() == 0


def test_hard_negatives_beyond_doubles(spark):
    rows = [(0, [2.0**21, 3.0], 0), (1, [2.0**21, 2.0], 0)] + [(i, [2.0**20, float(i) / 256], 1) for i in range(2, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, df.where("vec_id = 0"), leaf=4).collect())) == mined(rows, {0}, 5, 10) != []
    far = spark.createDataFrame([(0, [1e18], 0), (1, [1e18], 0)], SCHEMA)
    with pytest.raises(Exception, match="long"):
        hard_negatives.hard_negatives(far, far).count()


def test_tree_leaves_out_what_cannot_be_near():
    """In two dimensions most leaves stay closed; bounds hold for every row below every node."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(2000, 2)) * 256)
    order, nodes = hard_negatives.build_tree(v, 16)
    assert sorted(order) == list(range(2000))
    tree = hard_negatives.Tree(order, ["a"] * 2000, v[order], nodes)
    q = v[:50]
    lows, highs = tree.bounds(q)
    scores = q @ v[order].T
    for i, (a, b) in enumerate(zip(tree.start, tree.stop)):
        assert (scores[:, a:b] <= highs[:, i, None]).all() and (scores[:, a:b] >= lows[:, i, None]).all()
    anchor = hard_negatives.Anchor(tree, -1, "b", q[0], lows[0], highs[0], False, True)
    best = int(scores[0].max())
    found = anchor.nearest(best // 3, 9 * best // 10, 5)
    want = sorted((-int(s), int(i)) for s, i in zip(scores[0], order) if best // 3 <= s <= 9 * best // 10)[:5]
    assert [(-s, i) for i, s in found] == want
    assert len(anchor.opened) < (tree.near < 0).sum() / 4
