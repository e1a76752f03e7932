"""The same results in DuckDB SQL, for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import mixing

OP1 = """
WITH ok AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM ok
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|SEP\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|SEP\])', '\1\\\2\3', 'g') AS t,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(t) + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE 10 + length(r) + 9 + 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP7 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, list_transform(
    string_split_regex(regexp_replace(body, '<(/?(p|h1))>', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))
  ) AS blocks FROM a
)
SELECT a.page_id, a.url, regexp_replace(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '&amp(\n|$)', '&\1', 'g') AS text,
  CAST(length(regexp_replace(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)), '&amp(\n|$)', '&\1', 'g')) AS BIGINT) AS n_chars
FROM a JOIN b USING (page_id)
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g AS a JOIN g AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _weight(name: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items()))
    return f"CAST(CASE {name} {cases} ELSE {mixing.DEFAULT} END AS BIGINT)"


def _deal(name: str, source: str, parent: str, child: str, keep: str) -> str:
    """SQL of mixing.deal: the CTEs that give column got to the rows of source (b, w, c)."""
    before = f"OVER (PARTITION BY {parent} ORDER BY c / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_1 AS (
  SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY c / w, {child}) AS pos,
    (b - coalesce(sum(c) {before}, 0))::DOUBLE / (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) {before}, 0))::DOUBLE AS level FROM ({source})
), {name}_2 AS (
  SELECT *, min(pos) FILTER (WHERE c > floor(level * w)) OVER (PARTITION BY {parent}) AS first_free FROM {name}_1
), {name}_3 AS (
  SELECT *, max(level) FILTER (WHERE pos = first_free) OVER (PARTITION BY {parent}) AS cut FROM {name}_2
), {name} AS (
  SELECT {keep}, CAST(CASE WHEN first_free IS NULL OR pos < first_free THEN c ELSE least(c, floor(cut * w)) END AS BIGINT) AS got FROM {name}_3
)"""


OP10 = f"""
WITH k AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens,
    coalesce('d' || (CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % {mixing.DOMAINS}), '') AS d
  FROM documents
), leaf AS (
  SELECT d, l, s, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {mixing.EPOCHS} AS BIGINT) AS c FROM k GROUP BY 1, 2, 3
), {_deal("top", f"SELECT d, CAST(sum(c) AS BIGINT) AS c, 0 AS root, any_value((SELECT CAST(sum(tokens) AS BIGINT) FROM leaf)) AS b, {_weight('d', mixing.DOMAIN_WEIGHTS)} AS w FROM leaf GROUP BY d", "root", "d", "d")},
{_deal("mid", f"SELECT x.*, top.got AS b FROM (SELECT d, l, CAST(sum(c) AS BIGINT) AS c, {_weight('l', mixing.LANGUAGE_WEIGHTS)} AS w FROM leaf GROUP BY d, l) AS x JOIN top USING (d)", "d", "l", "d, l")},
{_deal("low", f"SELECT leaf.*, mid.got AS b, CAST({mixing.DEFAULT} AS BIGINT) AS w FROM leaf JOIN mid USING (d, l)", "d, l", "s", "d, l, s, tokens")},
e AS (
  SELECT k.*, epoch, low.got - low.tokens * (epoch - 1) AS room, md5('{mixing.SEED}' || ':' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM k JOIN low USING (d, l, s), range(1, {mixing.EPOCHS} + 1) AS r(epoch)
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY d, l, s, epoch ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, d AS domain, lang, source, tokens AS n_tokens FROM p WHERE before < room
"""

OP11 = """
WITH ok AS (
  SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM ok
), s AS (
  SELECT q.vec_id AS a, c.vec_id AS b, q.label = c.label AS alike, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3
), p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    (list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) % 2) = 1 AS hit
  FROM documents
), f AS (
  SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS t,
    list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')), lambda a, b: a || b) AS head
  FROM d
), l AS (
  SELECT doc_id, source, i, n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS tampered FROM f
), low AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, level, i // 3, (n + 2) // 3
), s AS (
  SELECT source, level AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), up AS (
  SELECT 0 AS level, i, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, i // 3, (n + 2) // 3
), low_sides AS (
  SELECT source, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, level, i // 3 ORDER BY i)
), up_sides AS (
  SELECT level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY level, i // 3 ORDER BY i)
), steps AS (
  SELECT l.source, l.i, x.level AS k, x.a, x.b FROM l JOIN low_sides AS x ON x.source IS NOT DISTINCT FROM l.source AND x.i = l.i // CAST(pow(3, x.level) AS BIGINT)
  UNION ALL
  SELECT l.source, l.i, s.depth + x.level, x.a, x.b FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN up_sides AS x ON x.i = s.i // CAST(pow(3, x.level) AS BIGINT)
), p AS (
  SELECT source, i, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256, count(*) AS m FROM steps GROUP BY source, i
), fold AS (
  SELECT source, i, 0 AS k, tampered AS h FROM l
  UNION ALL
  SELECT f.source, f.i, f.k + 1, sha256(x.a || f.h || x.b) FROM fold AS f JOIN steps AS x ON x.source IS NOT DISTINCT FROM f.source AND x.i = f.i AND x.k = f.k
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM up WHERE n = 1) AS r
LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.i = l.i
JOIN fold ON fold.source IS NOT DISTINCT FROM l.source AND fold.i = l.i AND fold.k = coalesce(p.m, 0)
"""

ORACLES = {"op1_exact_topk": OP1, "op4_chat_format": OP4, "op7_html_extract": OP7, "op8_ngram_join": OP8, "op10_mixing": OP10, "op11_hard_negatives": OP11, "op12_merkle_manifest": OP12}
