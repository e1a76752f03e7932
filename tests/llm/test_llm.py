import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat_format, exact_topk, html_extract, language_id, license_scan, mixing, ngram_join, packing
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0, 0.0) for i, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]).fetchdf())


def test_topk_ties_nulls_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [-0.001, 0.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = exact_topk.exact_topk(e, e.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 65536), (2, 65536), (2, 65536)]
    assert exact_topk.exact_topk(e, e.where("vec_id = 6"), 9).orderBy(F.desc("rank")).first().score == -256
    assert exact_topk.exact_topk(e.limit(0), e, 3).count() == 0
    # sums up to what a long holds are ranked rightly; beyond it the operator fails
    huge = spark.createDataFrame([(0, [1e7], 1), (1, [3e7], 1), (2, [4e7], 1), (3, [35000000.5], 1), (4, [-3e6], 1)], "vec_id long, embedding array<double>, score int")
    got = exact_topk.exact_topk(huge, huge.where("vec_id = 4"), 4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, -int(3e6 * 256) * int(v * 256)) for i, v in ((0, 1e7), (1, 3e7), (3, 35000000.5), (2, 4e7))]
    with pytest.raises(Exception, match="fit a long"):
        exact_topk.exact_topk(huge, spark.createDataFrame([(9, [1e30])], "vec_id long, embedding array<double>"), 1).collect()


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0. MIT License, mit LICENSE!", None, "", "mit", "cc by " * 3, "SPDX-License-Identifier: Apache-2.0", "x " * 20000 + "the MIT License"]
    out = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(license_scan.LOWER))
        at = [(j, l) for p, l in license_scan.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({l for _, l in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "cc-by-nc-4.0" in out[0].labels.split(",") and out[5].labels == "apache-2.0" and out[1].score == 0
    assert len(license_scan.Scanner().rules) > 200


def alternatives(parsed):
    """Texts of a parsed pattern: each branch, what is optional there or not."""
    out = [""]
    for op, av in parsed:
        op = str(op)
        if op == "LITERAL":
            found = [chr(av)]
        elif op == "SUBPATTERN":
            found = alternatives(av[3])
        elif op == "BRANCH":
            found = [x for b in av[1] for x in alternatives(b)]
        elif op == "MAX_REPEAT":
            found = [""] * (av[0] == 0) + (alternatives(av[2]) if av[1] == 1 else [" w"])
        else:
            found = [chr(v) if str(o) == "LITERAL" else "3" for o, v in av] if op == "IN" else [""]
        out = [a + b for a in out for b in found]
    return out


def test_license_keywords_let_every_alternative_through():
    import re._parser

    for r in license_scan.Scanner().rules:
        texts = [f" {' '.join(a.split())} " for a in alternatives(re._parser.parse(r.pattern.pattern))]
        texts = [t for t in texts if r.pattern.search(t)]
        assert texts and (r.label == "ms-pl" or all(any(k in t for k in r.keywords) for t in texts)), (r.label, r.keywords)
    for text, label in {
        "released into the public domain": "public-domain", "dedicated to the public domain": "public-domain", "Apache Software License": "apache",
        "Apache Software License, Version 1.1": "apache-1.1", "GNU Library General Public License": "lgpl", "Creative Commons Attribution Share Alike": "cc-by-sa",
        "Creative Commons Attribution Non Commercial": "cc-by-nc", "the zlib/libpng license": "zlib", "a proprietary licence": "proprietary", "MIT licence": "mit",
        "Licensed under the EUPL, Version 1.2 or – as soon they will be approved by the European Commission - subsequent versions of the EUPL": "eupl-1.2",
    }.items():
        assert label in license_scan.Scanner().scan(text)[5].split(","), text


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a</s>[INST]"), (1, 1, "user", r"<\/s>[\INST] [SEP]"), (1, 2, "assistant", None), (1, 3, "assistant", "x" * 50000), (2, None, None, None), (None, 0, "system", "é[/INST]"), (1, 0, "user", "a</s>[INST]")]
    c = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in c.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(r[2], r[3] or "") for r in (rows[0], rows[6], rows[1], rows[2], rows[3])]
    assert got[1].l == "x" * 50000 and [(t.role, t.text) for t in got[2].t] == [("", "")] and got[None].t[0].text == "é[/INST]"


def test_words_of_packing_equal_the_tokenizers_pattern():
    """Apart from the odd characters, the standard library's pattern cuts as the tokenizer's own does."""
    import public_tokenizers
    import regex

    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "a", "foo", "é", "12", "٣", ",", ".", "'s", "'re", "'", "_", "今天", "\u3000", "\xa0", "\r\n", "x1", "\u0301", "\u200b", "😀", "'ll", "'T"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(3000)]
    exact = regex.compile(public_tokenizers.PATTERN)
    assert [packing._WORDS.findall(t) for t in texts] == [exact.findall(t) for t in texts]


def test_words_are_cut_by_their_bytes():
    """Ids of words that are encoded together, each as the tokenizer has it alone; by places of words if bytes don't add up."""
    encode = packing._Encoder(packing.tokenizer_path())
    words = ["foo", " é", "今天", "😀", " unbelievably", "\u0301", "a\u0301b", "\r\n", "x" * 300, " ٣", "...", "ﬁ", "née", "naïf", "\u200b"]
    want = [np.array(encode.tok.encode([w], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert encode._encode(words) == want and encode.bytes.min() > 0
    encode.bytes = encode.bytes * 0 + 1
    assert encode._encode(words) == want
    gaps = encode._gaps([["a", "b", "a"], ["c"], ["b"]], [[None, b"", None], [b""], [None]])
    assert [(x, i, w) for x, i, w in gaps] == [([None, b"", None], 0, "a"), ([None, b"", None], 2, "a"), ([None], 0, "b")]


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", None, "", "it's ²½ x\x1c  \n\n  y <|endoftext|>", "word " * 9000] + [f"n {i} " * (i % 97) for i in range(200)]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs(spark, texts), group=50).collect()
    for i, t in enumerate(texts):
        ids = np.frombuffer(b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)), "<u4")
        assert ids.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and sum(used.values()) > 0.9 * 2048 * len(used) - 4 * 2048
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in packing.pack(twice).orderBy("doc_id").collect()] == [None, None, 1]


def test_first_fit_decreasing_equals_brute_force():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= sizes[i]


def test_ann_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(600, 16)), np.ones((200, 16)), np.zeros((2, 16))]).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None)], "vec_id long, embedding array<float>")
    out = ann.nearest(e, e.where("vec_id % 20 = 0"), 10).toPandas()
    hit = 0
    for q in range(0, 800, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[[q, 800, 801]] = -1e9
        best = sorted(range(802), key=lambda i: (-round(s[i], 9), i))[:10]
        hit += len(set(best) & set(out[out.query_id == q].vec_id))
    odd = spark.createDataFrame([(0, [1.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 3.0, 1.0, 1.0], 1), (3, [3.0, 0.0], 1), (4, [5.0], 1)], "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.vec_id, r.score) for r in ann.nearest(odd, odd, 5).collect()}  # only vectors of one length meet
    assert got == {(0, 4, 5.0), (4, 0, 5.0), (1, 3, 6.0), (3, 1, 6.0)}
    assert ann.nearest(odd.limit(0), odd, 5).count() == 0 and ann.nearest(odd, odd.limit(0), 5).count() == 0
    assert hit / 400 > 0.9 and set(out.groupby("query_id").size()) == {10}


def test_html(spark):
    page = "<html><body><header>H</header><nav><ul><li>n</ul></nav><article><h1>T&amp;t</h1><p>a<br>b <b>c</b><p>d</article><div class=comments><p>no</div><footer>f"
    rows = [(i, f"http://h.x/{i}", page.replace("a<", f"a{i}<")) for i in range(5)] + [(7, None, None), (8, "http://h.x", ""), (9, "http://h.x", page[:90])]
    out = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2].text == "T&t\na2 b c\nd" and out[2].n_chars == len(out[2].text) and out[7].text == "" and out[8].text == ""
    a, b = html_extract.page_wrapper("<p>x<p>y"), html_extract.page_wrapper("<p>x</p><ul></ul>")
    assert [(n[0], n[1], n[2]) for n in html_extract.merge(a, b)[3]] == [("p", 0, 1), ("ul", 1, 0)]


def test_html_template_without_telling_names(spark):
    """Menu, notice and advert in plain and hashed divs: only what the host's pages tell of them can leave them out."""
    page = "<body><div><a>Home</a></div><div class=x{}>We use cookies</div><div><p>Own {} text</p><p>More of {}</p></div>{}<div>Imprint</div>"
    rows = [(i, f"http://h.x/{i}", page.format(7, i, i, f"<section>Buy {i % 4}</section>" if i % 3 else "")) for i in range(40)]
    rows += [(50 + i, f"http://two.x/{i}", page.format(7, i, i, "")) for i in range(2)] + [(60 + i, f"http://copy.x/{i}", page.format(7, 1, 1, "")) for i in range(9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_pages(table).collect()}
    assert all(out[i] == f"Own {i} text\nMore of {i}" for i in range(40))
    whole = "Home\nWe use cookies\nOwn {0} text\nMore of {0}\nImprint"  # two pages, or copies of one, tell nothing
    assert [out[50], out[51], out[68]] == [whole.format(0), whole.format(1), whole.format(1)]
    assert html_extract.extract(rows[0][2], html_extract.Wrapper(["", 0, 0, []])) != out[0]


def test_html_wrapper_knows_all_kinds_at_any_depth(spark):
    """A notice that takes turns is template behind 300 kinds of siblings and below 300 levels; a text of a place that all have isn't, at that share."""
    letters = "abcdefghijklmnopqr"
    kinds = [f"k{a}{b}" for a in letters for b in letters][:300]
    wide = lambda i: "".join(f"<div class={k}>{'Buy now' if k == kinds[-1] and i % 6 == 0 else f'{k} of {i}'}</div>" for k in kinds)
    deep = lambda i, n: "<div>" * n + f"<p>{'Same' if i % 6 == 0 else f'Own {i}'}</p>" + (f"<section>Buy {i % 4}</section>" if i % 3 else "") + "</div>" * n
    rows = [(i, f"http://wide.x/{i}", "<body>" + wide(i)) for i in range(40)]
    rows += [(100 * k + i, f"http://deep{n}.x/{i}", "<body>" + deep(i, n)) for k, n in ((1, 20), (2, 300)) for i in range(40)]
    out = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[6] == "\n".join(f"{k} of 6" for k in kinds[:-1]) and out[7] == "\n".join(f"{k} of 7" for k in kinds)
    assert all(out[100 * k + i] == ("Same" if i % 6 == 0 else f"Own {i}") for k in (1, 2) for i in range(40))
    a, b = (html_extract.page_wrapper("<div>" * 20000 + x) for x in ("<p>x", "<p>x</p><ul>"))
    both = html_extract.dump(html_extract.merge(a, b))
    assert html_extract.dump(html_extract.load(both)) == both and both.endswith('"div",0,0,2,"p",0,0,1,"#",0,0,0,"ul",1,0,0]')


def test_html_drops_nothing_else():
    read = lambda page: html_extract.extract(page, html_extract.Wrapper(["", 0, 0, []]))
    assert read(f"<div class='{'u-pad ' * 20}sidebar'>no</div><p>yes") == "yes"
    assert read(f"<div>no</div><div class='{'u-pad ' * 20}article-body'>yes</div>") == "yes"
    assert read("<article>" + "<b>" * 300 + "a<script>no</script><div class=comments>no</div><nav>no</nav></b> c</article>d") == "a\nc"
    assert read("<div>" * 5000 + "deep") == "deep" and html_extract.page_wrapper("<div>" * 5000 + "deep")
    assert read("<p>no</p><main><h1>Title</h1><article><p>Body</article></main><p>no</p>") == "Title\nBody"
    assert read("<div class=content><p>Body<article>Teaser</article><p>more</div><div>no</div>") == "Body\nTeaser\nmore"
    assert read("<div class=post>no</div><article>a</article><article>b</article>") == "a\nb"


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_classes_equal_brute_force(spark, size, percent):
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, rng.integers(30, 200))) for _ in range(6)]
    texts = [None, "", " ", "one", "ONE", "one two"]
    for _ in range(150):
        t = list(base[rng.integers(6)])
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(len(t))] = str(rng.integers(10**6))
        texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(docs(spark, texts + texts[:20]), size, percent).collect()}
    texts = texts + texts[:20]
    sets = [set(ngram_join.shingles(t, size).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_language(spark, sf):
    out = QUERIES["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
    odd = docs(spark, [None, "", "123 !?", "the"])
    assert [r.lang_pred for r in language_id.predict(odd, None).orderBy("doc_id").collect()] == ["und"] * 4
    assert language_id.train(odd.limit(0)) is None
    m = language_id.train(odd)
    assert [r.lang_pred for r in language_id.predict(odd, m).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]


def test_code_length_is_a_distribution():
    """Method C without exclusion, by the definition, byte by byte."""
    text = "abracadabra abracad"
    g, n = np.unique(language_id.grams(text.encode(), 3), return_counts=True)
    m = language_id.build_model(["x"], np.zeros(len(g), int), g.astype(np.int64), n.astype(float))
    data = b"\0\0\0" + text.encode()
    counts = {}
    for i in range(3, len(data)):
        for k in range(4):
            d = counts.setdefault(data[i - k : i], {})
            d[data[i]] = d.get(data[i], 0) + 1

    def bits(context, b):
        d = counts.get(context, {})
        total, kinds = sum(d.values()), len(d)
        if b in d:
            return -np.log2(d[b] / (total + kinds))
        below = bits(context[1:], b) if context else 8.0
        return (-np.log2(kinds / (total + kinds)) if d else 0.0) + below

    other = "cabala zebra"
    padded = b"\0\0\0" + other.encode()
    assert np.isclose(language_id.code_lengths(m, other)[0], sum(bits(padded[i - 3 : i], padded[i]) for i in range(3, len(padded))))


def test_mixing_edges(spark):
    rows = [(i, "x" * 40, "en" if i % 2 else None, "a" if i < 30 else None, 0, 0, 0.0) for i in range(60)] + [(70, None, "en", "a", 0, 0, 0.0)]
    out = mixing.mix(spark.createDataFrame(rows, DOC), total=300)
    assert 250 <= out.agg(F.sum("_tokens")).first()[0] <= 340
    assert mixing.mix(spark.createDataFrame(rows, DOC).limit(0)).count() == 0
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.got for r in mixing.budgets(leaves, total=800, epochs=1).collect()}
    assert got == {"a": 10, "b": 490, "c": 300}  # a's shortage stays with its sibling


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= 2048
    texts = ["alpha beta gamma delta epsilon zeta eta theta"] * 2 + ["12345"]
    kept = corpus_pipeline.stage_near_copies(spark, docs(spark, texts), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == corpus_pipeline.COLUMNS
