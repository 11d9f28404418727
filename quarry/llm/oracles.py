"""DuckDB SQL for the rows of the queries that SQL can express over whole tables in reasonable time."""

TOP_K = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE later),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM w),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY a.j) AS kept FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.j = g.j GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.a
"""

MIXING = r"""
WITH r AS (SELECT doc_id, source, CAST(len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']) AS BIGINT) AS size, md5(concat_ws('|', '8', CAST(doc_id AS VARCHAR), md5(text))) AS draw FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS k, CAST('0x' || substr(draw, 1, 13) AS BIGINT) AS bits FROM r),
s AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)),
f AS (SELECT *, (1.5::DOUBLE * CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT min_by(l, 2.0::DOUBLE * source_size / weight) FROM f WHERE l <= 2.0::DOUBLE * source_size / weight)) AS target FROM s),
c AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
n AS (SELECT c.source, k, words, source_size, target, (target - 2.0::DOUBLE * CAST(coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / nullif(CAST(sum(words * (k + 8)) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS l FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, max_by(l, k) FILTER (l >= 0 AND l * (k + 8) <= 2.0::DOUBLE * (1 + 1e-12::DOUBLE)) OVER (PARTITION BY source) AS level FROM n),
e AS (SELECT *, least(2.0::DOUBLE, coalesce(level, 0) * (k + 8)) AS expected, CAST(floor(least(2.0::DOUBLE, coalesce(level, 0) * (k + 8)) + 1e-9::DOUBLE) AS BIGINT) AS whole FROM m),
p AS (SELECT *, CASE WHEN expected - whole < 2e-9::DOUBLE THEN 0.0::DOUBLE ELSE expected - whole END AS p, greatest(0.0::DOUBLE, target - CAST(sum(whole * words) OVER (PARTITION BY source) AS DOUBLE)) AS rest FROM e),
u AS (SELECT d.doc_id, d.source, d.size, d.draw, source_size, target, whole, p, rest, (CAST(bits AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.k = p.k),
v AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS v FROM u),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, v IS NULL ORDER BY v, draw, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) - size / 2.0::DOUBLE AS middle FROM v)
SELECT doc_id, size, source_size, target, CAST(size * (whole + (v IS NOT NULL AND middle <= rest)::INT) AS BIGINT) AS taken, CAST(whole + (v IS NOT NULL AND middle <= rest)::INT AS INTEGER) AS copies, p AS inclusion, v / (1 - v) AS q FROM o
"""

SUFFIX_DEDUP = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM b WHERE length(x) >= 100),
h AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM p),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM h) WHERE doc_id > first),
o AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM f)),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM o GROUP BY doc_id, run),
g AS (SELECT r.doc_id, s, e, x, coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) AS before FROM r JOIN b ON r.doc_id = b.doc_id),
k AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM g GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM b LEFT JOIN k ON b.doc_id = k.doc_id
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS h FROM documents),
i AS (SELECT g, min(item_id) AS item_id, CAST(count(*) AS BIGINT) AS n_items FROM (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS g FROM benchmark) GROUP BY g),
s AS (SELECT *, g[q + 1] AS a, g[q + 4] AS b, g[q + 7] AS c, g[q + 10] AS e FROM (SELECT *, unnest(range(0, len(g) - 9)) AS q FROM i WHERE len(g) >= 13)),
t AS (SELECT *, h[p + 1] AS a, h[p + 4] AS b, h[p + 7] AS c, h[p + 10] AS e FROM (SELECT *, unnest(range(0, len(h) - 9)) AS p FROM d WHERE len(h) >= 10)),
m AS (SELECT doc_id, item_id, n_items, g, p, list_max([list_sum([CASE WHEN p + o >= 0 AND q + o >= 0 AND h[p + o + 1] = g[q + o + 1] THEN 1 ELSE 0 END FOR o IN range(z, z + 13)]) FOR z IN [-3, -2, -1, 0]]) AS best
  FROM t JOIN s USING (a, b, c, e)),
w AS (SELECT doc_id, unnest(h) AS x, unnest(range(0, len(h))) AS spot FROM d),
v AS (SELECT item_id, n_items, g, len(g) AS n, unnest(g) AS x, unnest(range(0, len(g))) AS q FROM i WHERE len(g) BETWEEN 1 AND 12),
u AS (SELECT doc_id, item_id, n_items, g, spot - q AS p, count(*) AS best, any_value(n) AS n FROM w JOIN v USING (x) GROUP BY doc_id, item_id, n_items, g, spot - q),
z AS (SELECT doc_id, item_id, n_items, g, p, best FROM m WHERE best >= 11 UNION ALL SELECT doc_id, item_id, n_items, g, p, best FROM u WHERE best >= n - n * 2 // 13)
SELECT doc_id, item_id, n_items, CAST(count(DISTINCT p) AS BIGINT) AS n_hits, CAST(max(best) AS BIGINT) AS best FROM z GROUP BY doc_id, item_id, n_items, g
"""
