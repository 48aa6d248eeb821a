"""SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
ds AS (SELECT DISTINCT doc_id, s FROM sh),
n AS (SELECT doc_id, count(*) AS c FROM ds GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM ds a JOIN ds b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * k >= 4 * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON r.node = e.a),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
bag AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS h FROM sh GROUP BY doc_id),
first AS (SELECT h, min(doc_id) AS copy_of FROM bag GROUP BY h)
SELECT d.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(copy_of, d.doc_id) AS copy_of
FROM documents d JOIN class ON d.doc_id = node LEFT JOIN links ON d.doc_id = a LEFT JOIN bag ON d.doc_id = bag.doc_id LEFT JOIN first USING (h)"""

OP3 = """WITH x AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, x, unnest(range(0, n - 49, 200)) AS base FROM x WHERE n >= 50),
q AS (SELECT doc_id, base, least(200, n - 49 - base) AS k, substr(x, 2 * base + 1, 500) AS part FROM p),
w AS (SELECT doc_id, unnest(list_transform(range(0, k), lambda i: {'i': base + i, 's': hash(substr(part, 2 * i + 1, 100))})) AS e FROM q),
s AS (SELECT doc_id, e.i AS i, e.s AS s FROM w),
f AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM s JOIN f USING (s) WHERE doc_id > m),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, TRUE) AS new FROM r),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT c.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) || substr(any_value(x), (2 * max(z) + 1)::BIGINT) AS kept
  FROM cuts c JOIN x USING (doc_id) GROUP BY c.doc_id)
SELECT x.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM x LEFT JOIN kept USING (doc_id)"""

OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND r <= 5 AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
l AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM l, a),
p AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50"""

OP13 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 's': md5(array_to_string(w[i:i + 49], ' '))})) AS e FROM d WHERE len(w) >= 50),
f AS (SELECT e.s AS s, min(doc_id) AS m FROM s GROUP BY e.s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, s.e.i AS i FROM s JOIN f ON s.e.s = f.s WHERE doc_id > m),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM d),
y AS (SELECT x.doc_id, count(c.k) AS n_removed, coalesce(string_agg(t, ' ' ORDER BY x.k) FILTER (c.k IS NULL), '') AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""
