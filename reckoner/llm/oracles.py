"""DuckDB's SQL for those corpus queries that SQL can express at a bearable cost on small tables."""

from __future__ import annotations

_WORDS = r"(SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"

SUBSTRING = rf"""
WITH d AS {_WORDS}, win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM win SEMI JOIN rep USING (s)),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM hit) GROUP BY 1),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d), cov AS (SELECT doc_id, unnest(g) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM link GROUP BY 1), c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, c.c = vec_id AS kept FROM e JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS {_WORDS}, sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, c = p.n AND c = q.n AS same FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
k AS (SELECT x, count(*) AS n, min(y) FILTER (same) AS least FROM link GROUP BY 1), c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(k.least, doc_id)) AS class_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, c.c = doc_id AS kept FROM d JOIN c ON c.x = doc_id LEFT JOIN k ON k.x = doc_id
"""

_REFERENCE = r"!\[[^\[\]]*\]\([^()#\x00-\x20]+\.(?i:{})(?:#[^()\x00-\x20]*)?\)"
_SHOWN = "text"
for _kind, _suffixes in (("image", "png|jpe?g|gif|webp|bmp|svg"), ("audio", "mp3|wav|ogg|flac|m4a"), ("document", "pdf|docx?|pptx?|xlsx?|html?|csv")):
    _SHOWN = f"regexp_replace({_SHOWN}, '{_REFERENCE.format(_suffixes)}', '[{_kind}]', 'g')"

CHATS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
s AS (SELECT *, length(replace(replace({_SHOWN}, '\', '\e'), '<', '\l')) + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) + length('<turn >_</turn>_') AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(size) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT doc_id, len({_TERMS}) AS n, {_TERMS} AS t FROM documents), q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
g AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n) AS length FROM d),
p AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS t FROM d) SEMI JOIN q USING (t) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length))))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10
"""
