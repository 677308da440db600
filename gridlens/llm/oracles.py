"""DuckDB SQL for the queries that SQL can express on whole tables."""

OP5 = r"""
WITH ok AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.rid <> q.rid),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3 = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text,
         md5(coalesce('r' || role, '-') || '|' || coalesce('t' || text, '-')) AS hash
  FROM conversations),
p AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce(CAST(turn AS VARCHAR), '~') || ':' || hash, ',') OVER w AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, hash ROWS UNBOUNDED PRECEDING)),
keep AS (
  SELECT min(conv_id) AS conv_id, n FROM p
  WHERE k = n AND pre NOT IN (SELECT pre FROM p WHERE k < n) GROUP BY pre, n)
SELECT t.conv_id, keep.n AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS LAST, hash) AS rendered
FROM t JOIN keep ON t.conv_id = keep.conv_id GROUP BY 1, 2
"""

_TREE = "".join(f"""
s{k + 1} AS (
  SELECT source, rank, 2 * shard + CASE WHEN row_number() OVER (PARTITION BY shard ORDER BY md5('mix-{k}:' || coalesce(source, 'null') || ':' || rank), source, rank)
         > floor(count(*) OVER (PARTITION BY shard) / 2) THEN 1 ELSE 0 END AS shard FROM s{k}),""" for k in range(3))

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)) AS place FROM documents),
a AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
b AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, row_number() OVER o AS pos,
         CAST(coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS given,
         CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w
  FROM a WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
f AS (SELECT *, (150 * total - 100 * given) * w <= 100 * cap * left_w AS free FROM b),
g AS (SELECT pos AS pos0, given AS given0, left_w AS left0 FROM f WHERE free ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN pos >= pos0 THEN (CAST(1.5 AS DOUBLE) * total - given0) * w / left0 ELSE CAST(cap AS DOUBLE) END AS target
  FROM f LEFT JOIN g ON true),
u AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS INTEGER) AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM u),
c AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest, sum(size) OVER (PARTITION BY d.source ORDER BY place) AS fin
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
cut AS (SELECT source, max(place) FILTER (fin <= rest) AS cut, any_value(rest) AS rest, coalesce(sum(size) FILTER (fin <= rest), 0) AS got,
               min(substr(place, 1, 2)) FILTER (fin > rest) AS over_block FROM c WHERE rest > 0 GROUP BY source),
x AS (
  SELECT d.source, min(struct_pack(off := abs(size - (rest - got)), place := place)).place AS extra
  FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
  WHERE place > coalesce(cut, '') AND abs(size - (rest - got)) < rest - got GROUP BY d.source),
q AS (
  SELECT c.*, coalesce(cut.cut, '') AS cut, cut.over_block, place = coalesce(extra, '') AS is_extra,
         CAST(least(2, whole + CASE WHEN cut.rest IS NOT NULL AND (place <= coalesce(cut.cut, '') OR place = coalesce(extra, '')) THEN 1 ELSE 0 END) AS INTEGER) AS copies
  FROM c LEFT JOIN cut ON c.source IS NOT DISTINCT FROM cut.source LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source),
h AS (SELECT DISTINCT source, substr(place, 1, 2) AS block, whole, over_block FROM q),
k AS (
  SELECT source, block, 1 AS pass FROM h WHERE whole >= 1
  UNION SELECT source, block, least(whole + 1, 2) FROM h WHERE whole >= 2 OR block <= over_block),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('mix-blocks:' || coalesce(source, 'null') || ':' || block || ':' || pass), pass, block) AS rank FROM k),
s0 AS (SELECT source, rank, 0 AS shard FROM m),
TREE
runs AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard, rank) AS rank FROM s3),
y AS (SELECT m.source, m.block, m.pass, runs.shard FROM m JOIN runs ON m.source IS NOT DISTINCT FROM runs.source AND m.rank = runs.rank)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * q.copies AS BIGINT) AS taken,
       CASE WHEN copies >= 1 THEN y1.shard END AS shard_1, CASE WHEN copies >= 2 THEN y2.shard END AS shard_2
FROM q
LEFT JOIN y y1 ON q.source IS NOT DISTINCT FROM y1.source AND y1.pass = 1 AND y1.block = CASE WHEN whole >= 1 OR NOT is_extra THEN substr(place, 1, 2) ELSE over_block END
LEFT JOIN y y2 ON q.source IS NOT DISTINCT FROM y2.source AND y2.pass = 2 AND y2.block = CASE WHEN is_extra THEN over_block ELSE substr(place, 1, 2) END
"""

OP6 = OP6.replace("TREE", _TREE)

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM p),
f AS (SELECT doc_id, i, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0 FROM g WINDOW o AS (PARTITION BY s ORDER BY doc_id, i)),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE (doc_id, i) <> (d0, i0)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (
  SELECT words.doc_id, count(*) FILTER (cover.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (cover.i IS NULL) AS kept
  FROM words LEFT JOIN cover ON words.doc_id = cover.doc_id AND words.i = cover.i GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s.doc_id, n, s.s, df FROM s JOIN n USING (doc_id) JOIN (SELECT s, count(*) AS df FROM s GROUP BY s) USING (s)),
r AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS k FROM f),
c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  WHERE a.k <= a.n - (80 * a.n + 99) // 100 + 1 AND b.k <= b.n - (80 * b.n + 99) // 100 + 1),
i AS (SELECT a, b, na, nb, count(*) AS m FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.s = y.s GROUP BY a, b, na, nb),
e AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * m >= 80 * (na + nb - m)),
sym AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, reach.c FROM reach JOIN sym ON sym.a = reach.v AND reach.c < sym.b)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id, w.doc_id = min(c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON w.doc_id = reach.v GROUP BY w.doc_id, n
"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT rid, unnest(range(i, i + 5)) AS i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM r GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (base_failed) AS host_failed FROM b GROUP BY source),
p AS (SELECT avg(host_failed / host_docs) AS m, var_samp(host_failed / host_docs) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 10 END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host_failed + m * k) / (host_docs + k) <= 0.5 AS kept, host_docs, host_failed
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source JOIN k ON true
"""
