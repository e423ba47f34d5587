"""SQL twins, for DuckDB, of the queries that SQL can express."""

from .line_dedup import LINES, WORDS
from .mixing import TIMES
from .near_dup import SHINGLE, SIMILAR

MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n, (SELECT sum(size) FROM d) AS total FROM s),
c AS (
  SELECT *, coalesce(sum({TIMES} * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM r),
f AS (
  SELECT coalesce(max(n) FILTER ((total - below) / weights * w >= {TIMES} * source_size), 0) AS n_full FROM c),
g AS (
  SELECT source, source_size, CASE WHEN n <= n_full THEN ({TIMES} * source_size)::DOUBLE ELSE
    (max(total) OVER () - coalesce(sum({TIMES} * source_size) FILTER (n <= n_full) OVER (), 0))::DOUBLE
    / (sum(w) FILTER (n > n_full) OVER ())::DOUBLE * w END AS target
  FROM c, f),
p AS (
  SELECT d.*, g.source_size, g.target, least(round(g.target)::BIGINT, {TIMES} * g.source_size) AS words,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + least(greatest(words % source_size - pos, 0), size) END::BIGINT AS taken
FROM p
"""

LINES_GONE = f"""
WITH d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS doc FROM documents),
l AS (
  SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (
  SELECT doc, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS nth FROM k WHERE words > 0),
w AS (
  SELECT a.doc, a.nth, a.pos, n, sum(b.words) AS words, string_agg(b.line, chr(10) ORDER BY b.nth) AS run
  FROM s a, range(1, {LINES} + 1) r(n), s b WHERE b.doc = a.doc AND b.nth BETWEEN a.nth AND a.nth + n - 1
  GROUP BY a.doc, a.nth, a.pos, n HAVING count(*) = n AND (n = {LINES} OR sum(b.words) >= {WORDS})),
f AS (
  SELECT n, run, min((doc, pos)) AS first FROM w GROUP BY n, run),
g AS (
  SELECT DISTINCT s.doc, s.pos FROM w JOIN f USING (n, run) JOIN s ON s.doc = w.doc AND s.nth BETWEEN w.nth AND w.nth + w.n - 1
  WHERE (w.doc, w.pos) > f.first),
t AS (
  SELECT l.doc, count(*) AS n_lines, count(g.pos) AS n_deleted, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text
  FROM l LEFT JOIN g ON g.doc = l.doc AND g.pos = l.pos GROUP BY l.doc)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text
FROM d LEFT JOIN t ON t.doc = d.doc
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' '))) END AS s
  FROM w),
t AS (
  SELECT doc_id, unnest(s) AS x FROM s),
n AS (
  SELECT doc_id, len(s) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {SIMILAR} * (x.n + y.n - shared)),
e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

MAIN_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)>', ' ', 'g'), '<[^>]+>', '', 'g') AS body FROM a),
c AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
         '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS body FROM b),
t AS (
  SELECT page_id, url, trim(regexp_replace(body, '[\s\x{00A0}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
e AS (
  SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN first IS NOT NULL AND (e.doc_id IS NULL OR e.doc_id > first) THEN 'E' ELSE '' END AS fails
  FROM e LEFT JOIN l ON l.doc_id = e.doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (translate(fails, before || letter, '') = fails), 0) AS kept,
         coalesce(sum(n) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails), 0) AS removed,
         coalesce(sum(n) FILTER (contains(fails, letter) AND translate(fails, before, '') <> fails), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
a AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM d),
m AS (
  SELECT row, doc_id, w, 10 + (90 * len(w) * n_docs) // greatest(total, 1) AS m FROM d, a),
p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM m) GROUP BY row, term),
t AS (
  SELECT item, item_id, unnest(w) AS term FROM i),
v AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, a GROUP BY term, n_docs),
s AS (
  SELECT item, item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM t JOIN v USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op3_top_k": NEAREST,
    "op5_mixing": MIX,
    "op7_line_dedup": LINES_GONE,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_page_text": MAIN_TEXT,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_lexical_search": LEXICAL,
}
