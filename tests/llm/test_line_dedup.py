import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, x, edits, words):
    x = list(x)
    for _ in range(edits):
        i, kind = int(rng.integers(0, len(x) + 1)), rng.integers(3)
        if kind == 0:
            x.insert(i, words[rng.integers(len(words))])
        elif kind == 1 and len(x) > 1:
            x.pop(min(i, len(x) - 1))
        else:
            x[min(i, len(x) - 1)] = words[rng.integers(len(words))]
    return x


@pytest.mark.parametrize("edits", [1, 2, 3, 8])
def test_distance_equals_brute_force(spark, edits):
    rng = np.random.default_rng(edits)
    pairs = []
    for _ in range(300):
        a = rng.integers(0, 6, rng.integers(0, 14)).tolist()
        b = [int(v) for v in edited(rng, a, rng.integers(0, 5), list(range(6)))] if a else []
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    pairs = [p for p in pairs if len(p[1]) - len(p[0]) <= edits]
    for r in spark.createDataFrame(pairs, "a array<long>, b array<long>").select("a", "b", line_dedup.distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        d = levenshtein(r.a, r.b)
        assert r.d == d if d <= edits else r.d > edits


def brute_force(rows, edits, per_edit):
    """The definition: lines in order of doc_id (nulls first) and place, each against all distinct ones before it."""
    seen, raw, out = [], set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, equal, near, n = [], 0, 0, 0
        for l in (text or "").split("\n"):
            if not l.strip():
                kept.append(l)
                continue
            n += 1
            if l in raw:
                equal += 1
                continue
            w = l.split(" ")
            most = lambda s: min(edits, min(len(w), len(s)) // per_edit)  # noqa: B023, E731
            if any(most(s) and abs(len(w) - len(s)) <= most(s) and levenshtein(w, s) <= most(s) for s in seen):
                near += 1
            else:
                kept.append(l)
            seen.append(w)
            raw.add(l)
        out.append((doc_id, None if text is None else "\n".join(kept), n, equal, near))
    return out


@pytest.mark.parametrize("edits,per_edit,few,kinds", [(1, 3, 16, 200), (2, 4, 0.02, 12)])
def test_line_dedup_equals_brute_force(spark, edits, per_edit, few, kinds):
    """Copies with edits and lines of one template; with few = 0.02 keys are divided
    again and again. Names of columns inside the operator clash with nothing."""
    rng = np.random.default_rng(edits + kinds)
    words = [f"w{i}" for i in range(kinds)]
    base = [list(rng.choice(words, int(rng.integers(4, 26)))) for _ in range(5)]
    lines = [" ".join(edited(rng, base[rng.integers(5)], rng.integers(0, 6), words)) for _ in range(160)]
    lines += ["published on {} by user {} in the news section of our site {}".format(*rng.integers(0, 9, 3)) for _ in range(80)]
    rng.shuffle(lines)
    rows = [(i, "\n".join([*lines[8 * i : 8 * i + 8], "", "short", "\t"])) for i in range(30)] + [(None, lines[3]), (41, None), (42, ""), (43, "\n\n")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, 5) for i, t in rows], "doc_id long, text string, _id long, _keep long, row string, at int, parts int, n_near int")
    out = line_dedup.drop_repeated_lines(docs, edits, per_edit, few)
    assert out.columns == [*docs.columns[:-1], "n_lines", "n_equal", "n_near"]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_equal, r.n_near) for r in out.collect()), key=key) == brute_force(rows, edits, per_edit)


def test_line_dedup_edges(spark):
    run = lambda rows: sorted(tuple(r) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 4).collect())
    assert run([]) == []
    long = " ".join(f"w{i}" for i in range(3000))
    # rows that repeat an id and a text are one document; other texts of that id are not
    assert run([(1, "a b"), (1, "a b"), (1, "a b\nc")])[:2].count((1, "a b", 1, 0, 0)) + run([(1, "a b"), (1, "a b"), (1, "a b\nc")]).count((1, "", 1, 1, 0)) == 2
    assert run([(1, long), (2, long.replace("w7 ", "x "))]) == [(1, long, 1, 0, 0), (2, "", 1, 0, 1)]
    chinese = "今天天气很好我们去公园散步"
    assert run([(1, chinese), (2, chinese.replace("公", "花"))])[1] == (2, "", 1, 0, 1)
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string"), 0, 4)


def test_a_place_serves_all_lengths_of_a_class(spark):
    """Rows that are shuffled to find shared keys: 5 own ones and 64 asked for where each length of the other line has keys of its own."""
    for n, most in ((45, 19), (40, 32)):
        lines = spark.createDataFrame([(1, [f"w{i}" for i in range(n)])], "h long, w array<string>")
        assert line_dedup.keyed(lines, ["h"], 4, 10).select("key").distinct().count() <= most


def test_line_dedup_takes_keys_in_rounds(spark, monkeypatch):
    """With more shared keys than may be broadcast at once nothing is lost, and lines meet them without a shuffle of their words."""
    monkeypatch.setattr(line_dedup, "KEYS", 40)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    base = [list(rng.choice(words, int(rng.integers(4, 26)))) for _ in range(6)]
    lines = [" ".join(edited(rng, base[rng.integers(6)], rng.integers(0, 4), words)) for _ in range(120)]
    rows = [(i, "\n".join(lines[8 * i : 8 * i + 8])) for i in range(15)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2, 4)
    assert sorted(tuple(r) for r in out.collect()) == brute_force(rows, 2, 4)
    w = spark.createDataFrame(rows, "doc_id long, text string").select(F.split("text", " ").alias("w"))
    keyed = line_dedup.keyed(w, ["w"], 2, 4)
    plan = line_dedup.under(keyed, keyed.select("key").distinct())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
