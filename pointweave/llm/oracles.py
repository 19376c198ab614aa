"""SQL texts that must agree with the queries of operators 2, 6 and 7."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a AS s, b AS t FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT s AS node, s AS reach FROM e UNION SELECT r.node, e.t FROM r JOIN e ON e.s = r.reach),
m AS (SELECT node, min(reach) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(m.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""

DECONTAMINATION = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
items AS (SELECT id AS item, w, least(10, len(w)) AS m FROM w WHERE kind = 'b' AND len(w) > 0),
g AS MATERIALIZED (SELECT item, m, i AS j, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT item, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
docs AS (SELECT id AS doc_id, w, m FROM w, (SELECT DISTINCT m FROM g) WHERE kind = 'd' AND len(w) >= m),
p AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs)),
hit AS MATERIALIZED (SELECT doc_id, i, j, m, b.item AS it FROM p JOIN g b USING (m, g)),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
y AS (SELECT doc_id, count(DISTINCT it) AS n_items, string_agg(DISTINCT it::VARCHAR, ',' ORDER BY it::VARCHAR) AS names FROM hit GROUP BY 1),
runs AS (SELECT doc_id, min(i) - 1 AS begun, count(*) + min(m) - 1 AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, it, i - j ORDER BY i) AS run FROM hit) GROUP BY doc_id, it, i - j, run),
z AS (SELECT doc_id, max(n) AS longest, arg_min(begun, row(-n, begun)) AS longest_at FROM runs GROUP BY 1)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest, 0) AS longest, longest_at
FROM w LEFT JOIN x ON x.doc_id = id LEFT JOIN y ON y.doc_id = id LEFT JOIN z ON z.doc_id = id WHERE kind = 'd'
"""

REPEATS = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i, i > 100 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS apart FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM p) WHERE nth > 1),
runs AS MATERIALIZED (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later) GROUP BY 1, 2),
cut AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prior FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS head, max(hi) AS hi, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
