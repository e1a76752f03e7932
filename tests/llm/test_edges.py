import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat_format, html_extract, language_id, license_scan, mixing, ngram_join
from tidemark.llm.common import components
from tidemark.llm.queries import QUERIES


def test_chat_rows_are_sorted_before_escaping(spark):
    rows = [(1, 0, "user", "<a", 1), (1, 0, "user", "<s>", 1), (1, 0, "user", "<s>", 1)]
    made = lambda rows: chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    assert [t.text for t in made(rows).select(chat_format.read_turns(F.col("formatted")).alias("t")).first().t] == ["<a", "<s>", "<s>"]
    assert made([]).count() == 0


def test_chat_mask_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(500)]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [made.formatted[m.start : m.start + m.length] for m in made.loss_mask] == [r[3] for r in rows[1::2]]


def test_mixing_carries_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "x" * 40, "en", "a", 7, 8, 9) for i in range(9)], "doc_id long, text string, lang string, source string, _cut int, _domain int, before int")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "_cut", "before", "_domain", "_epoch", "_tokens"] and out.first()._cut == 7


def test_ngram_percent_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_shingles int")
    assert ngram_join.ngram_classes(docs, 3, 90).count() == 0
    with pytest.raises(ValueError):
        ngram_join.ngram_classes(docs, 1, 50)


@pytest.mark.parametrize("percent", [80, 90])
def test_tree_pairs_lose_no_link(percent):
    """Every pair of sets that links, in different groups, is among the tree's pairs; the tree leaves out most others."""
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(20, 120))).astype(np.uint64)
        for _ in range(4):
            keep = base[rng.random(len(base)) > rng.random() * 0.12]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)])))
    bits = [ngram_join.bitmap(s) for s in sets]
    folded = np.stack([ngram_join.fold(b, min(map(len, bits))) for b in bits])
    group = rng.integers(0, 90, len(sets))
    a, b = ngram_join.tree_pairs(np.array([len(s) for s in sets]), group, folded, np.zeros(len(sets), np.int64), percent)
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if group[i] != group[j] and ngram_join.linked(sets[i], sets[j], percent)}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) // 20


def test_narrow_bitmaps_of_trees_lose_no_link(spark):
    """What the trees are given is a quarter as wide as the bitmaps that decide, and still holds every pair that links."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(900, 1100))).astype(np.uint64)
        sets += [np.unique(base[rng.random(len(base)) > rng.random() * 0.08]) for _ in range(4)]
    wide = [ngram_join.bitmap(s) for s in sets]
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(wide)], "sid long, bits binary")
    narrow = [bytes(r.bits) for r in ngram_join._signatures(table).orderBy("sid").collect()]
    assert [4 * len(b) for b in narrow] == [len(b) for b in wide]
    folded = np.stack([ngram_join.fold(b, min(map(len, narrow))) for b in narrow])
    n, none = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
    a, b = ngram_join.tree_pairs(n, np.arange(len(sets)), folded, none, 90)
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j], 90)}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) // 20


def test_tree_joins_what_hubs_leave(spark):
    """Chains in which each text only links with the next: no hub is near all, so the classes need the tree's pairs."""
    rng = np.random.default_rng(3)
    texts = []
    for c in range(12):
        words = [f"c{c}w{i}" for i in range(100)]
        for step in range(14):
            texts.append(" ".join(words))
            for i in rng.integers(0, 100, 2):
                words[i] = f"c{c}s{step}x{i}"
    got = [r.component_id for r in ngram_join.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 80).orderBy("doc_id").collect()]
    sets = [set(ngram_join.shingles(t, 3).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert got == comp


def test_trees_give_forests_of_near_copies(spark, monkeypatch):
    """A group whose texts are near each other but not all near a hub: the trees give fewer pairs than it has members in
    buckets, not its square for each bucket, and the classes are those of all pairs."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(200)], []
    for _ in range(150):
        words = list(base)
        for i in rng.integers(0, 200, 2):
            words[i] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    made, rows, search = [], [], ngram_join._tree_search

    def counted(members, *args):
        out = search(members, *args).cache()
        rows.append(members.count())
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_tree_search", counted)
    got = [r.component_id for r in ngram_join.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).orderBy("doc_id").collect()]
    sets = [ngram_join.shingles(t, 3) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if ngram_join.linked(sets[i], sets[j], 90):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert got == comp and len(set(comp)) < len(comp)
    assert made and made[0] and all(m <= r for m, r in zip(made, rows))


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(6)
    group, a, b = rng.integers(0, 400, 900), rng.integers(0, 900, 3000), rng.integers(0, 900, 3000)
    keep = ngram_join.forest(a, b, group)

    def classes(a, b):
        comp = np.arange(400)
        for x, y in zip(group[a], group[b]):
            comp[comp == max(comp[x], comp[y])] = min(comp[x], comp[y])
        return comp

    assert (classes(a[keep], b[keep]) == classes(a, b)).all() and keep.sum() < 400 and keep[np.flatnonzero(group[a] != group[b])[0]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}


def test_language_many_and_clashing(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"l{i:03}", 1, 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, score int")
    out = language_id.identify(docs)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.where("lang = lang_pred").count() == 300
    assert language_id.identify(docs.limit(0)).count() == 0


def test_scan_and_html_tables(spark):
    docs = spark.createDataFrame([(1, "MIT license", 5), (1, "MIT license", 5), (None, None, 5)], "doc_id long, text string, labels int")
    assert [(r.doc_id, r.base_labels) for r in license_scan.scan_licenses(docs).orderBy("doc_id").collect()] == [(None, ""), (1, "mit"), (1, "mit")]
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://h.x/1", "<p>a", 5), (1, "http://h.x/1", "<p>a", 5)], "page_id long, url string, html string, text int")
    assert [r.text for r in html_extract.extract_pages(pages).collect()] == ["a", "a"] and html_extract.extract_pages(pages.limit(0)).count() == 0


def test_ann_recall_on_its_table(spark):
    """The registered query against brute force in double precision."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL").toPandas()
    ok = e["embedding"].map(lambda v: all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v))
    e = e[ok]
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"].map(lambda v: np.asarray(v, float)).to_list())
    out = QUERIES["op6_ann"](spark, "/root/testdata/sf0.01").toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        hit, n = hit + len(out[ids[i]] & set(ids[best])), n + len(best)
    assert hit >= 0.9 * n


def test_ann_graph_is_built_by_insertion():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 40, 3000):
        x = rng.normal(size=(n, 24))
        g = ann.Graph.build(x, 8)
        assert len(g.layers[-1][0]) == n and all(set(a) <= set(b) for (a, _), (b, _) in zip(g.layers, g.layers[1:]))
        for nodes, links in g.layers:
            held = {int(a): {int(b) for b in row if b >= 0} for a, row in zip(nodes, links)}
            assert links.shape[1] == 16 and all(a not in b and b <= set(held) for a, b in held.items())
            assert all((row >= 0).sum() == len(held[int(a)]) for a, row in zip(nodes, links))  # no link twice
            seen, todo = set(), [int(a) for a in nodes[:1]]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += held[a] - seen
            assert len(seen) >= 0.99 * len(nodes)
        if n == 3000:
            q = x[::20]
            true = np.argsort(-(q @ x.T), axis=1)[:, :10]
            found = g.search(q, 96)[:, :10]
            assert np.mean([len(set(a) & set(b)) for a, b in zip(found, true)]) >= 9


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    """Nulls, repeats, other columns and empty tables through each stage; planted lines, copies and letterless texts are caught."""
    import corpus_pipeline as p

    en = ["the quick brown fox jumps over the lazy dog and then the old man walks home with all of his friends in the evening"] * 8
    de = ["der schnelle braune fuchs springt über den faulen hund und dann geht der alte mann am abend mit seinen freunden nach hause"] * 8
    rows = [(i, t + f" number {i} of this", "en" if i < 8 else "de", f"s{i % 2}", 0) for i, t in enumerate(en + de)]
    rows += [(20, "12345 !!", None, None, 0), (21, None, None, "s0", 0), (22, rows[0][1], None, "s1", 0), (22, rows[0][1], None, "s1", 0), (None, en[0] + " without an id here", "en", None, 0)]
    docs = spark.createDataFrame(rows, PLAIN).withColumn("more", F.lit(1))
    told = p.stage_language(spark, docs, "")
    assert told.columns == p.COLUMNS and {r.doc_id for r in told.collect()} >= set(range(16)) and not {20, 21} & {r.doc_id for r in told.collect()}
    assert all(r.lang == "en" for r in told.where("doc_id = 22").collect())
    lines = p.stage_lines(spark, spark.createDataFrame([(1, "a line\nown one", "en", "s", 0), (2, "a line\nother", "en", "s", 0), (3, None, None, None, None)], PLAIN), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {1: ("a line\nown one", 14), 2: ("other", 5), 3: (None, None)}
    words = [f"w{i}" for i in range(60)]
    near = [(1, " ".join(words), "en", "s", 0), (2, " ".join([*words[:59], "x"]), "en", "s", 0), (3, " ".join(reversed(words)), "en", "s", 0), (4, None, None, None, 0), (None, " ".join(words), "en", "s", 0)]
    kept = p.stage_near_copies(spark, spark.createDataFrame(near, PLAIN), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    mixed = p.stage_mixing(spark, docs, "")
    assert mixed.columns == p.COLUMNS and mixed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() <= 1
    packed = p.stage_packing(spark, docs, "")
    assert packed.where("start = 0").count() == len(rows) and packed.where("offset < 0 OR offset + length > 2048").count() == 0
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, PLAIN).write.parquet(f"{path}/documents.parquet")
    out = p.run(spark, path)
    assert out.count() > 0 and out.where("doc_id IN (20, 21)").count() == 0
