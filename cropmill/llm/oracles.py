"""The queries of this subpackage as SQL for DuckDB, where SQL can express them on whole tables."""

from __future__ import annotations

from cropmill.llm.licenses import PHRASES, TEMPLATES, words_of

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join(f"('{label}', {sorted(set(words_of(t)))!r})" for label, t in TEMPLATES)
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())

LICENSES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
ph AS (SELECT * FROM (VALUES {_PHRASES}) v(p, label)),
pl AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, p, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = p[1])) AS i FROM d, ph) WHERE w[i : i + len(p) - 1] = p),
b AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS own FROM pl GROUP BY 1),
bl AS (SELECT doc_id, list_distinct(regexp_extract_all(translate(unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(0), 'g'), '\\n[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*\\n', chr(0), 'g'), chr(0))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS ws FROM d),
te AS (SELECT * FROM (VALUES {_TEMPLATES}) v(label, t)),
m AS (SELECT doc_id, label, len(list_intersect(ws, t)) / len(t) AS s FROM bl, te WHERE len(ws) > 0 AND len(list_intersect(ws, t)) >= ceil(0.8::DOUBLE * len(t) - 1e-9)),
h AS (SELECT doc_id, max(s) AS s, count(*) AS n, list(DISTINCT label) AS more FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(own), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(h.s, 0.0::DOUBLE) END AS score, coalesce(h.n, 0) AS n_blocks
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)"""

REPEATS = f"""WITH pw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ph AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM pw WHERE len(w) >= 50)),
pn AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM ph WHERE h IN (SELECT h FROM ph GROUP BY h HAVING count(DISTINCT doc_id) > 1)) GROUP BY 1),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d),
k AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM p),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY 1, 2),
c AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
e AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS tail FROM s GROUP BY 1),
o AS (SELECT doc_id, string_agg(hex(b[before + 1 : a]), '' ORDER BY a) AS x FROM c JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(o.x || hex(b[tail + 1 :])) END) AS kept_sha256, coalesce(pn.n, 0) AS n_passage_words
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN pn USING (doc_id)"""

WARC = """WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM q LEFT JOIN f USING (payload_digest)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens)),
hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
wd AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN wd USING (doc_id) LEFT JOIN it USING (doc_id)"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) * 3 - length(replace(text, '\', '')) - length(replace(text, '<', '')) - length(replace(text, '[', '')) AS n, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS same FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (4 + sum(n + CASE WHEN same THEN 2 WHEN role = 'assistant' THEN 11 WHEN role = 'user' THEN 14 WHEN role = 'system' THEN 12 END))::BIGINT AS formatted_chars FROM e GROUP BY 1"""

NEIGHBOURS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
