"""DuckDB SQL that gives the rows of those queries that SQL can express."""

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}'), [])"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(pattern=r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(c.v, q.v), lambda z: z[1] * z[2])) / (c.n * q.n) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_SECRET_RULES = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "random": "[A-Za-z0-9+/_=-]{20,}",
}
_PARTS = "get set user name list item file path data index count value table token cache node time date type page total first last read write parse build make load open close start stop max min order line key map row column test config default handler manager service request response session context buffer stream"
_WORD = "w[((id * 9 + {}) * 48271 % 2147483647) % len(w) + 1]"

OP4 = f"""
WITH letters AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')) AS c),
b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
chance AS (SELECT base64(unhex(sha256('r' || id))) AS code, regexp_replace(base64(unhex(sha256('r' || id))), '[+/=]', '', 'g') AS plain, sha256('h' || id) AS h FROM range(1500) x(id)),
parts AS (SELECT string_split('{_PARTS}', ' ') AS w),
four AS (SELECT {_WORD.format(0)} AS a, {_WORD.format(1)} AS b, {_WORD.format(2)} AS c, {_WORD.format(3)} AS d, ((id * 9 + 8) * 48271 % 2147483647) % 1000 AS n FROM range(1500) x(id), parts),
samples AS (SELECT 1 AS label, unnest([substr(code, 1, 40), substr(plain, 1, 32), substr(upper(plain), 1, 24), substr(lower(plain), 1, 28), substr(h, 1, 40)]) AS s, 1 AS n FROM chance
  UNION ALL SELECT 0, unnest([concat_ws('_', a, b, c, d), concat_ws('-', a, b, c, d), a || upper(b[1]) || b[2:] || upper(c[1]) || c[2:] || upper(d[1]) || d[2:], upper(concat_ws('_', a, b, c, d)), concat_ws('/', a, b, c, d), concat_ws('_', a, b, c, d, n)]), 1 FROM four
  UNION ALL SELECT 0, s, count(*) FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]+')) AS s FROM b) WHERE regexp_full_match(s, '[A-Za-z+/_=-]{{6,}}') AND NOT regexp_matches(s, '[0-9a-f]{{16,}}') GROUP BY s),
met AS (SELECT label, substr(s, i, 1) AS x, substr(s, i + 1, 1) AS y, sum(n) AS n FROM (SELECT label, s, n, unnest(range(1, length(s))) AS i FROM samples) GROUP BY 1, 2, 3),
grid AS (SELECT l.label, p.c AS x, q.c AS y, coalesce(n, 0) AS n FROM (VALUES (0), (1)) l(label), letters p, letters q LEFT JOIN met ON met.label = l.label AND met.x = p.c AND met.y = q.c),
chances AS (SELECT label, x, y, (n + 0.5) / CAST(sum(n) OVER (PARTITION BY label, x) + 0.5 * 67 AS DOUBLE) AS p FROM grid),
ratios AS (SELECT x, y, round(ln(max(p) FILTER (label = 1) / max(p) FILTER (label = 0)), 6) AS ratio FROM chances GROUP BY 1, 2),
cut AS ({' UNION ALL '.join(f"SELECT r, {k} AS rank, '{name}' AS kind, regexp_extract_all(t, '{rule}') AS hits, string_split_regex(t, '{rule}') AS gaps FROM b" for k, (name, rule) in enumerate(_SECRET_RULES.items()))}),
hit AS (SELECT r, rank, kind, i, hits[i] AS hit, length(gaps[i]) + length(hits[i]) AS step FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut WHERE len(hits) > 0)),
span AS (SELECT r, rank, kind, hit, CAST(sum(step) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS e, length(hit) AS n FROM hit),
base AS (SELECT r, rank, kind, e - n AS s, e FROM span WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(regexp_extract(hit, '{_SECRET_RULES["assign"]}', 2)) >= 12)),
runs AS (SELECT r, e - n AS s, e, hit FROM span WHERE kind = 'random' AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')),
likely AS (SELECT r, s, e FROM (SELECT r, s, e, sum(ratio) AS z FROM (SELECT r, s, e, hit, unnest(range(1, length(hit))) AS i FROM runs) JOIN ratios ON x = substr(hit, i, 1) AND y = substr(hit, i + 1, 1) GROUP BY 1, 2, 3) WHERE z >= 11),
free AS (SELECT l.r, l.s, p FROM (SELECT r, s, e, unnest(range(s, e)) AS p FROM likely) l WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = l.r AND base.s <= p AND p < base.e)),
added AS (SELECT r, min(p) AS s, max(p) + 1 AS e FROM (SELECT r, s, p, p - row_number() OVER (PARTITION BY r, s ORDER BY p) AS run FROM free) GROUP BY r, s, run),
every AS (SELECT r, rank, kind, s, e, true AS own FROM base UNION ALL SELECT r, 3, 'random', s, e, false FROM added),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (own) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM b LEFT JOIN told USING (r)"""

OP5 = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT r, s, array_slice(t, s + 1, s + 200) AS k FROM (SELECT r, t, unnest(range(0, octet_length(t) - 199)) AS s FROM b WHERE octet_length(t) >= 200)),
d AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM d),
i AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM g),
x AS (SELECT r, run, min(s) AS a, max(s) + 200 AS z FROM i GROUP BY 1, 2),
n AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY 1),
p AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS u FROM x UNION ALL SELECT b.r, coalesce(max(z), 0), any_value(octet_length(t)) FROM b LEFT JOIN x ON x.r = b.r GROUP BY b.r),
k AS (SELECT r, string_agg(CASE WHEN u > f THEN hex(array_slice(t, f + 1, u)) ELSE '' END, '' ORDER BY f) AS kept FROM p JOIN b USING (r) GROUP BY 1)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM b JOIN k USING (r) LEFT JOIN n USING (r)"""

OP6 = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
d AS (SELECT r, doc_id, octet_length(raw) + 1 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM b, tab),
k AS (SELECT r, CAST(CASE WHEN doc_id IS NULL THEN 11400714819323198485 WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE doc_id END AS UBIGINT) AS k FROM b),
m1 AS (SELECT r, CAST(CAST(xor(k, k >> 30) AS UHUGEINT) * 13787848793156543929 % 18446744073709551616 AS UBIGINT) AS k FROM k),
m2 AS (SELECT r, CAST(CAST(xor(k, k >> 27) AS UHUGEINT) * 10723151780598845931 % 18446744073709551616 AS UBIGINT) AS k FROM m1),
j AS (SELECT r, n, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS reach, xor(k, k >> 31) AS state FROM m2, (VALUES (8), (9)) v(n)
  UNION ALL SELECT r, n, reach, CAST(floor((reach + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(state2 >> 33 AS DOUBLE) + 1))) AS BIGINT), state2
  FROM (SELECT *, CAST((CAST(state AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) AS state2 FROM j WHERE reach < n)),
e AS (SELECT r, max(shard) FILTER (n = 8) AS shard, max(shard) FILTER (n = 9) AS grown_shard FROM j GROUP BY 1),
o AS (SELECT greatest(32, count(*) // 50000) AS n FROM documents),
s AS (SELECT d.*, shard, grown_shard, (((coalesce(doc_id, -7046029254386353131) % n) + n) % n + text_crc32 % n) % n AS bucket FROM d JOIN e USING (r), o)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(pattern=r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(pattern=r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
m AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT m.doc_id, m.s, m.n, p.item_id FROM m JOIN p ON p.x = m.x AND p.n = m.n),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
