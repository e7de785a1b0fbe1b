"""DuckDB SQL for the rows of those text queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_secret_scans"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pattern(kind, name, scan, grp, least) AS (VALUES
  (0, 'assign', '([\s\S]*?)(((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))|[\s\S]+', 4, 12),
  (1, 'access', '([\s\S]*?)(AKIA[A-Z0-9]+)|[\s\S]+', 2, 18),
  (2, 'hex', '([\s\S]*?)([0-9a-f]{16,})|[\s\S]+', 2, 16)),
hit AS (
  SELECT doc_id, 0 AS kind, unnest(regexp_extract_all(text, (SELECT scan FROM pattern WHERE kind = 0), 1)) AS gap, unnest(regexp_extract_all(text, (SELECT scan FROM pattern WHERE kind = 0), 2)) AS m,
         unnest(regexp_extract_all(text, (SELECT scan FROM pattern WHERE kind = 0), 4)) AS v, generate_subscripts(regexp_extract_all(text, (SELECT scan FROM pattern WHERE kind = 0), 1), 1) AS i FROM d
  UNION ALL
  SELECT doc_id, kind, unnest(regexp_extract_all(text, scan, 1)), unnest(regexp_extract_all(text, scan, 2)), unnest(regexp_extract_all(text, scan, 2)), generate_subscripts(regexp_extract_all(text, scan, 1), 1)
  FROM d, pattern WHERE kind > 0),
placed AS (SELECT doc_id, kind, v, len(m) AS n, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM hit),
base AS (SELECT doc_id, kind, v, e - n AS s, e FROM placed JOIN pattern USING (kind) WHERE n > 0 AND len(v) >= least),
chars AS (
  SELECT doc_id, i, c FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM d WHERE doc_id IN (SELECT doc_id FROM base) AND text <> '')),
blank AS (
  SELECT doc_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.doc_id = chars.doc_id AND b.s <= chars.i AND chars.i < b.e) THEN ' ' ELSE c END, '' ORDER BY i) AS text
  FROM chars GROUP BY doc_id
  UNION ALL SELECT doc_id, text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM base)),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '([\s\S]*?)([A-Za-z0-9+/_=-]{16,})|[\s\S]+', 1)) AS gap, unnest(regexp_extract_all(text, '([\s\S]*?)([A-Za-z0-9+/_=-]{16,})|[\s\S]+', 2)) AS m,
         generate_subscripts(regexp_extract_all(text, '([\s\S]*?)([A-Za-z0-9+/_=-]{16,})|[\s\S]+', 1), 1) AS i FROM blank),
candidate AS (SELECT doc_id, m, e - len(m) AS s, e FROM (SELECT *, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM run) WHERE m <> ''),
sample AS (
  SELECT 0 AS side, v AS t FROM placed WHERE n > 0 AND len(v) >= 12
  UNION ALL SELECT 1, t FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9+/_=-]+')) AS t FROM d) WHERE regexp_full_match(t, '[A-Za-z]+(?:[_-][A-Za-z]+)*')),
pairs AS (SELECT side, unnest(list_transform(range(1, len(t)), lambda i: substr(t, i, 2))) AS p FROM sample),
counted AS (SELECT side, ascii(p) AS a, ascii(substr(p, 2, 1)) AS b, count(*) AS n FROM pairs GROUP BY ALL HAVING a BETWEEN 43 AND 122 AND b BETWEEN 43 AND 122),
total AS (SELECT side, a, sum(n) AS n FROM counted GROUP BY side, a),
symbol AS (SELECT unnest(range(43, 123)) AS x),
model AS (
  SELECT sa.x AS a, sb.x AS b,
         round(ln((0.5::DOUBLE * (coalesce(r.n, 0) + 1) / (coalesce(rt.n, 0) + 66) + 0.5::DOUBLE / 66) / ((coalesce(q.n, 0) + 0.5::DOUBLE) / (coalesce(qt.n, 0) + 33))), 5) AS x
  FROM symbol sa CROSS JOIN symbol sb
  LEFT JOIN counted r ON r.side = 0 AND r.a = sa.x AND r.b = sb.x LEFT JOIN total rt ON rt.side = 0 AND rt.a = sa.x
  LEFT JOIN counted q ON q.side = 1 AND q.a = sa.x AND q.b = sb.x LEFT JOIN total qt ON qt.side = 1 AND qt.a = sa.x),
rated AS (
  SELECT doc_id, s, e, sum(x) AS ratio FROM (SELECT doc_id, s, e, unnest(list_transform(range(1, len(m)), lambda i: ascii(substr(m, i, 1)))) AS a, unnest(list_transform(range(1, len(m)), lambda i: ascii(substr(m, i + 1, 1)))) AS b FROM candidate)
  JOIN model USING (a, b) GROUP BY ALL),
spans AS (
  SELECT doc_id, kind, name, s, e FROM base JOIN pattern USING (kind)
  UNION ALL SELECT doc_id, 3, 'random', s, e FROM rated WHERE ratio >= 12.0 AND ratio >= 0.8 * (e - s - 1)),
written AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM documents LEFT JOIN written USING (doc_id)
"""

ORACLES["op2_language_id"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS words,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_resize([]::BIGINT[], 8, -1::BIGINT))))),
                     lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
e AS (SELECT *, xor(crc, 4294967295) % 3 = 1 AS held_out FROM d),
counts AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(words) AS w FROM e WHERE NOT held_out AND lang IS NOT NULL) GROUP BY lang, w),
langs AS (SELECT lang, sum(n)::DOUBLE AS total, max(sum(n)) OVER ()::DOUBLE AS most FROM counts GROUP BY lang),
pieces AS (SELECT DISTINCT lang, w, n, i, k FROM counts, range(1, 5) a(k), LATERAL (SELECT unnest(range(1, len(w) + 4 - k)) AS i)),
raw AS (
  SELECT 'w' AS kind, w AS key, lang, n FROM counts
  UNION ALL SELECT 'g', substr('^' || w || '$', i, k), lang, sum(n) FROM pieces GROUP BY ALL),
share AS (
  SELECT kind, key, l.lang, (coalesce(r.n, 0) + 0.05 * total / most) / total AS p
  FROM (SELECT DISTINCT kind, key FROM raw) CROSS JOIN langs l LEFT JOIN raw r USING (kind, key, lang)),
vote AS (SELECT kind, key, lang, round(ln(p / sum(p) OVER (PARTITION BY kind, key)) * 65536)::BIGINT AS v FROM share),
asked AS (SELECT DISTINCT unnest(words) AS w FROM e),
unseen AS (SELECT w FROM asked WHERE w NOT IN (SELECT w FROM counts)),
places AS (SELECT w, unnest(range(1, len(w) + 3)) AS i FROM unseen),
found AS (
  SELECT w, i, max(k) AS k FROM places, range(1, 5) a(k)
  WHERE i + k - 1 <= len(w) + 2 AND substr('^' || w || '$', i, k) IN (SELECT key FROM vote WHERE kind = 'g') GROUP BY w, i),
backed AS (
  SELECT w, lang, round(sum(v)::DOUBLE / count(*))::BIGINT AS v
  FROM found JOIN vote ON kind = 'g' AND key = substr('^' || w || '$', i, k) GROUP BY w, lang),
votes AS (SELECT key AS w, lang, v FROM vote WHERE kind = 'w' UNION ALL SELECT * FROM backed),
sums AS (SELECT doc_id, lang, sum(n * v) AS x FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM e) GROUP BY ALL) JOIN votes USING (w) GROUP BY doc_id, lang),
best AS (SELECT doc_id, arg_min(lang, (-x, lang)) AS lang_pred, max(x) AS most FROM sums GROUP BY doc_id),
scored AS (SELECT doc_id, any_value(lang_pred) AS lang_pred, round(1 / sum(exp((x - most)::DOUBLE / 65536)), 6) AS score FROM best JOIN sums USING (doc_id) GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM e LEFT JOIN scored USING (doc_id)
"""

ORACLES["op3_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, j, substr(h, 2000 * j + 1, 2400) AS p, len(h) // 2 AS n FROM (SELECT r, h, unnest(range(0, len(h) // 2000 + 1)) AS j FROM d)),
starts AS (SELECT r, p, 1000 * j + i AS s, i FROM (SELECT r, p, j, n, unnest(range(0, 1000)) AS i FROM part) WHERE s + 200 <= n),
keyed AS (SELECT r, s, md5(substr(p, 2 * i + 1, 400)) AS w FROM starts),
twice AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY w) AS c FROM keyed) WHERE c > 1),
island AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS k FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM twice)),
span AS (SELECT r, min(s) AS b, max(s) + 200 AS e FROM island GROUP BY r, k),
gone AS (SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
hole AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a, b FROM span
  UNION ALL SELECT r, coalesce(max(e), 0), len(any_value(h)) // 2 FROM d LEFT JOIN span USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM hole JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

# The pages of the test tables hold one plain article each, and no other character references; SQL reads that form alone.
ORACLES["op4_html_extraction"] = r"""
WITH part AS (
  SELECT page_id, url, unnest(string_split_regex(coalesce(regexp_extract(html, '<article>([\s\S]*?)</article>', 1), ''), '</?(?:p|h1)>')) AS p,
         generate_subscripts(string_split_regex(coalesce(regexp_extract(html, '<article>([\s\S]*?)</article>', 1), ''), '</?(?:p|h1)>'), 1) AS i
  FROM pages),
plain AS (
  SELECT page_id, url, i,
         trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')) AS p
  FROM part)
SELECT page_id, url, coalesce(string_agg(p, chr(10) ORDER BY i) FILTER (p <> ''), '') AS text, coalesce(len(string_agg(p, chr(10) ORDER BY i) FILTER (p <> '')), 0) AS n_chars
FROM plain GROUP BY page_id, url
"""

ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON doc_id = c.x LEFT JOIN n USING (doc_id)
"""

ORACLES["op11_importance_resampling"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM w UNION SELECT word FROM b)),
crc AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(h), 2), lambda i: list_concat([('0x' || substr(h, i, 2))::BIGINT], list_resize([]::BIGINT[], 8, -1::BIGINT))))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 10000 AS bucket
  FROM u),
s AS (SELECT bucket, count(*) AS s FROM w JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM w JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES["op12_hard_negatives"] = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES["op13_embedding_dedup"] = r"""
WITH RECURSIVE r AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""
