"""DuckDB twins of the queries that SQL can express; quadratic in places, for small tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS h FROM w, LATERAL unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS g(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON d.doc_id = m.a
"""

OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM w, LATERAL unnest(range(1, greatest(len(ws) - 33, 1))) AS g(i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(35) AS g(k)),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(ws[i], ' ' ORDER BY i) AS text FROM w, LATERAL unnest(range(1, len(ws) + 1)) AS g(i) ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.p = g.i GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ALNUM}) AS ws FROM benchmark),
t AS (SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[i : i + 7], ' ') AS x FROM b, LATERAL unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS g(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM t),
win AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS x FROM w, sizes, LATERAL unnest(range(1, greatest(len(ws) - n + 2, 1))) AS g(i)),
hits AS (SELECT DISTINCT win.doc_id, win.n, i, item_id FROM win JOIN t ON win.x = t.x AND win.n = t.n),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(8) AS g(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN places ON w.doc_id = places.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""

ORACLES = {"op3_near_dedup": OP3, "op8_substring_dedup": OP8, "op9_decontamination": OP9}
