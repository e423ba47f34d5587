"""SQL twins of the registered queries, over the same tables, written the direct way:
all pairs, recursive reachability, lists. They check results; they are no plan for scale."""

from __future__ import annotations

from ..config import LEXICON, STOP_WORDS
from ..functions.text import TOKEN, WORD
from ..operators.listing import LISTING_RULES

ORACLES: dict[str, str] = {}


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = _in(STOP_WORDS)
WORDS = _in(LEXICON)
TOKENS = f"regexp_extract_all(lower(text), '{TOKEN}')"
STREAM = f"array_to_string({TOKENS}, ' ')"
KEY = rf"regexp_replace(lower(text), '[^{WORD}\s'']', '', 'g')"
SPLIT = r"list_filter(regexp_split_to_array(%s, '\s+'), lambda w: w <> '')"
PROSE = rf"""replace(regexp_replace(text, '[^{WORD}\s\p{{Z}}''"$£€;\-:.,]', '', 'g'), '  ', ' ')"""
HITS = (f"list_transform([{{'key': {KEY}, 'ws': {SPLIT % KEY}}}], lambda s: list_filter([{WORDS}], "
        "lambda k: list_contains(s.ws, k) OR contains(s.key, k || ' ')))[1]")
ASOF = "TIMESTAMP '2024-01-30 12:00:00'"
URL = "'https://' || source || '.example.org/' || doc_id"
DATE = "DATE '2024-01-01' + CAST(doc_id % 30 AS INT)"

# ---------------------------------------------------------------- sources

ORACLES["csv_round_trip"] = f"""
SELECT source, 'all' AS section, text AS title, {URL} AS url, CAST({DATE} AS VARCHAR) AS date, lang AS subheading FROM documents"""

ORACLES["union_sources_by_name"] = f"""
SELECT source, {URL} AS url, lang AS section, n_chars AS size FROM documents
UNION ALL SELECT 'web', url, NULL, -1 FROM pages
UNION ALL SELECT role, conv_id || '/' || turn, NULL, length(text) FROM conversations"""

# ---------------------------------------------------------------- text, dates, arrays

ORACLES["clean_text"] = rf"""
SELECT doc_id AS id, md5(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')) AS ascii_md5, length({PROSE}) AS prose_chars,
       md5({KEY}) AS key_md5, len({SPLIT % 'text'}) AS n_words, length(text) - length(replace(text, '-', '')) AS dashes,
       length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
       lower(text) = 'nan' OR trim(regexp_replace(text, '\s', ' ', 'g')) = '' AS missing
FROM documents"""

ORACLES["normalize_dates"] = rf"""
WITH e AS (SELECT *, user_id % 23 AS n FROM events)
SELECT event_id,
  CAST(CAST(CASE WHEN event_type IN ('error', 'click', 'purchase') THEN {ASOF} ELSE ts END AS DATE) AS VARCHAR) AS parsed,
  CAST(CAST(CASE event_type WHEN 'error' THEN {ASOF} - to_hours(n) WHEN 'click' THEN {ASOF} - to_days(CAST(n AS INT)) ELSE {ASOF} END AS DATE) AS VARCHAR) AS spelled,
  CAST(CASE event_type WHEN 'error' THEN {ASOF} - to_hours(n) WHEN 'click' THEN {ASOF} - to_minutes(n) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS VARCHAR) AS short,
  CAST(CAST(CASE WHEN event_type = 'error' THEN {ASOF} - to_hours(n) WHEN event_type IN ('click', 'view') THEN ts
       ELSE {ASOF} - to_days(CAST(n AS INT)) END AS DATE) AS VARCHAR) AS spaced
FROM e"""

ORACLES["keyword_strings"] = f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) AS p FROM documents),
u AS (SELECT doc_id, w, min(p) AS p FROM t GROUP BY ALL),
l AS (SELECT doc_id, list(w ORDER BY p) AS ws FROM u GROUP BY ALL)
SELECT d.doc_id AS id, md5(coalesce(array_to_string(ws, ','), '')) AS parsed_md5, coalesce(len(ws), 0) AS n_split, 0 AS n_empty
FROM documents d LEFT JOIN l USING (doc_id)"""

# ---------------------------------------------------------------- pages

CLEAN = r"regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim({out})"


def _element(pattern: str) -> str:
    return f"nullif({_plain(f'''regexp_extract({CLEAN}, '{pattern}', 1)''')}, '')"


H1 = _element("(?s)<h1[^>]*>(.*?)</h1>")
TITLE = _element("(?s)<title[^>]*>(.*?)</title>")
LANG = "nullif(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1), '')"
LINKS = rf"""'(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""
ARTICLE = f"regexp_extract({CLEAN}, '(?s)<article[^>]*>(.*?)</article>', 1)"
# no look-ahead here: cut at every opening tag, then each piece at its closing tag
PARAS = (rf"list_transform(regexp_split_to_array(%s, '<p(?:\s[^>]*)?>')[2:], "
         f"lambda c: {_plain('split_part(c, ' + chr(39) + '</p>' + chr(39) + ', 1)')})")

# what the cards made of each navigation link must read as
LISTING_CARDS = rf"""
WITH n AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS host, regexp_extract_all({CLEAN}, '<li><a href="/([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
                  regexp_extract_all({CLEAN}, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2) AS raws FROM pages),
l AS (SELECT page_id, host, unnest(hrefs) AS x, unnest(raws) AS raw, generate_subscripts(hrefs, 1) - 1 AS pos FROM n),
p AS (SELECT page_id, host, pos, x, {_plain('raw')} AS t FROM l),
c AS (SELECT page_id, source, pos::INTEGER AS pos, CASE source WHEN 'FOX' THEN trim(t || ' for the day') WHEN 'WAPO' THEN trim(t || ' of this day' || chr(10) || ' now')
               WHEN 'NYT' THEN trim(t || ' one two three') WHEN 'HuffPost' THEN trim('Opinion: ' || t || ' one two three') ELSE t END AS title,
             host || '/' || x || CASE source WHEN 'WAPO' THEN '-a-b-c' ELSE '' END AS url,
             CASE source WHEN 'NYT' THEN '2024-01-05' WHEN 'NPR' THEN '2024-01-05' WHEN 'CBS' THEN '2024-01-29' ELSE '2024-01-30' END AS date,
             CASE WHEN source NOT IN ('NYT', 'CBS') THEN 'https://i.example.org/' || x || '.png' END AS image,
             CASE source WHEN 'FOX' THEN NULL WHEN 'NPR' THEN trim('Jan 5 • About ' || t) ELSE trim('About ' || t) END AS subheading
      FROM p, (VALUES ('FOX'), ('WAPO'), ('NYT'), ('AP'), ('NPR'), ('HuffPost'), ('CBS')) s(source))"""

ORACLES["page_body_text"] = f"""
WITH b AS (SELECT page_id, array_to_string({PARAS % ARTICLE}, ' ') AS body FROM pages)
SELECT page_id, length(body) AS chars, md5(body) AS body_md5 FROM b"""

ORACLES["page_body_by_source"] = f"""
WITH p AS (SELECT page_id, {PARAS % ARTICLE} AS ps FROM pages),
b AS (SELECT page_id, source, CASE WHEN source IN ('NYT', 'OTHER') THEN NULL WHEN source = 'FOX' THEN array_to_string(ps[2:], ' ')
      ELSE array_to_string(ps, ' ') END AS body
      FROM p, (VALUES ('FOX'), ('NPR'), ('AP'), ('CBS'), ('NYT'), ('OTHER')) s(source))
SELECT page_id, source, coalesce(length(body), -1) AS chars, md5(body) AS body_md5 FROM b"""

ORACLES["listing_cards"] = LISTING_CARDS + """
SELECT page_id, source, 'front' AS section, pos, title, url, date, image, subheading FROM c"""

ORACLES["listing_articles"] = LISTING_CARDS + """,
t AS (SELECT page_id, source, pos, url, trim(CASE source WHEN 'HuffPost' THEN replace(title, 'Opinion:', '') WHEN 'WAPO' THEN replace(title, chr(10), '') ELSE title END) AS title,
             CASE source WHEN 'NPR' THEN trim(substr(subheading, strpos(subheading, '•') + 1)) ELSE subheading END AS subheading FROM c),
k AS (SELECT *, length(title) - length(replace(title, ' ', '')) AS blanks, length(url) - length(replace(url, '-', '')) AS dashes FROM t
      WHERE NOT (source = 'FOX' AND (contains(lower(title), 'quiz') OR contains(lower(title), 'political cartoons of the day')))),
g AS (SELECT * FROM k WHERE source IN ('FOX', 'CBS', 'AP', 'NPR') OR blanks >= 3 AND (source <> 'WAPO' OR dashes >= 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY page_id, pos) AS nth FROM g)
SELECT page_id, source, pos, title, url, subheading FROM r WHERE nth = 1 OR source IN ('FOX', 'WAPO', 'CBS')"""

ORACLES["page_headline"] = f"""
SELECT page_id, {H1} AS headline, {TITLE} AS page_title, {_element('(?s)<h2[^>]*>(.*?)</h2>')} AS subheading,
       nullif(regexp_extract({CLEAN}, '<time[^>]*datetime="([^"]*)"', 1), '') AS published,
       nullif(regexp_extract({CLEAN}, {LINKS}, 1), '') AS first_link, {LANG} AS language
FROM pages"""

ORACLES["page_links"] = f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all({CLEAN}, {LINKS}, 1)) AS href, unnest(regexp_extract_all({CLEAN}, {LINKS}, 2)) AS raw,
                  generate_subscripts(regexp_extract_all({CLEAN}, {LINKS}, 1), 1) - 1 AS pos FROM pages)
SELECT page_id, pos, href, {_plain('raw')} AS text FROM l"""

ORACLES["page_lead_image"] = """
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS x FROM pages),
i AS (SELECT page_id, list_transform(x, lambda v: CASE WHEN starts_with(v, 't') THEN 'https://img.example.org/' || v
             ELSE 'https://static.example.org/' || v END) AS a, list_transform(x, lambda v: 'https://face.example.org/' || v) AS b FROM h),
z AS (SELECT page_id, flatten(list_transform(range(1, len(a) + 1), lambda n: [a[n], b[n]])) AS imgs FROM i)
SELECT page_id, source, CASE source WHEN 'FOX' THEN list_filter(imgs[2:], lambda s: NOT starts_with(s, 'https://static.'))[1]
  WHEN 'CNN' THEN list_filter(imgs, lambda s: NOT contains(s, 'face'))[1] END AS image
FROM z, (VALUES ('FOX'), ('CNN'), ('AP')) s(source)"""

# ---------------------------------------------------------------- listings

LISTING = rf"""
h AS (SELECT page_id, {H1} AS title, 'Newsroom •  ' || {TITLE} AS sub, regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages),
l AS (SELECT page_id, title, sub, host || '/' || lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')) AS url,
             length(title) - length(replace(title, ' ', '')) AS spaces FROM h WHERE title IS NOT NULL),
m AS (SELECT *, length(url) - length(replace(url, '-', '')) AS dashes FROM l)"""

ORACLES["title_filters"] = f"""
WITH {LISTING}
SELECT 'FOX' AS source, page_id, title, sub AS subheading FROM m WHERE url IS NOT NULL AND NOT contains(lower(title), 'quiz')
       AND NOT contains(lower(title), 'political cartoons of the day')
UNION ALL SELECT 'CNN', page_id, title, sub FROM m WHERE length(title) >= 10 AND dashes >= 3 AND spaces >= 2
UNION ALL SELECT 'WAPO', page_id, replace(title, chr(10), ''), sub FROM m WHERE length(title) >= 3 AND dashes >= 3 AND spaces >= 3
UNION ALL SELECT 'NYT', page_id, title, sub FROM m WHERE spaces > 2
UNION ALL SELECT 'AP', page_id, title, sub FROM m WHERE replace(title, ' ', '') <> ''
UNION ALL SELECT 'NPR', page_id, title, trim(split_part(sub, '•', 2)) FROM m WHERE replace(title, ' ', '') <> ''
UNION ALL SELECT 'HuffPost', page_id, trim(replace(title, 'Opinion:', '')), sub FROM m WHERE spaces >= 3
UNION ALL SELECT 'CBS', page_id, title, sub FROM m"""

ORACLES["first_seen_listing"] = f"""
WITH t AS (SELECT s.source, role AS section, 'https://talk.example.org/' || conv_id AS url, conv_id * 1000 + turn AS pos
           FROM conversations, (VALUES {", ".join(f"('{s}')" for s in LISTING_RULES)}) s(source))
SELECT source, section, url, pos FROM t WHERE source IN ('FOX', 'CNN', 'WAPO', 'CBS')
UNION ALL SELECT source, section, url, pos FROM t WHERE source IN ('NYT', 'AP', 'HuffPost')
          QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY pos) = 1
UNION ALL SELECT source, section, url, pos FROM t WHERE source = 'NPR'
          QUALIFY row_number() OVER (PARTITION BY section, url ORDER BY pos) = 1"""

ORACLES["first_seen_url"] = """
SELECT source, md5(text) AS url, doc_id AS first_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""

NAV = f"""nav AS (SELECT source || '/' || doc_id AS menu, unnest({SPLIT % 'text'}) AS section,
                 generate_subscripts({SPLIT % 'text'}, 1) - 1 AS pos FROM documents)"""

ORACLES["sections_until_word"] = f"""
WITH {NAV}, f AS (SELECT *, max(CAST(contains(lower(section), 'of') AS INT)) OVER (PARTITION BY menu ORDER BY pos) AS hit FROM nav)
SELECT menu, count(*) AS n, max(pos) AS last_pos FROM f WHERE hit = 0 GROUP BY menu"""

ORACLES["sections_through_word"] = f"""
WITH {NAV}, f AS (SELECT *, coalesce(max(CAST(contains(lower(section), 'que') AS INT)) OVER
  (PARTITION BY menu ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit FROM nav)
SELECT menu, count(*) AS n, max(pos) AS last_pos FROM f WHERE hit = 0 GROUP BY menu"""

ORACLES["sections_until_repeat"] = f"""
WITH {NAV}, r AS (SELECT *, row_number() OVER (PARTITION BY menu, section ORDER BY pos) AS rn FROM nav),
f AS (SELECT *, max(CAST(rn > 1 AS INT)) OVER (PARTITION BY menu ORDER BY pos) AS hit FROM r)
SELECT menu, count(*) AS n, max(pos) AS last_pos FROM f WHERE hit = 0 GROUP BY menu"""

ORACLES["last_wins_section"] = f"""
WITH {NAV}, o AS (SELECT menu, section, min(pos) AS pos, 'https://nav.example.org/' || max(pos) AS url FROM nav GROUP BY ALL)
SELECT menu, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, max(url) AS max_url FROM o GROUP BY menu"""

ORACLES["section_exclusion"] = f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all({CLEAN}, {LINKS}, 1)) AS href, unnest(regexp_extract_all({CLEAN}, {LINKS}, 2)) AS raw,
                  generate_subscripts(regexp_extract_all({CLEAN}, {LINKS}, 1), 1) - 1 AS pos FROM pages),
m AS (SELECT page_id, pos, href, {_plain('raw')} AS section FROM l)
SELECT page_id, pos, section FROM m WHERE NOT contains(lower(href), 'th') AND section NOT IN ('', ' ', 'of', 'and')
  AND NOT (contains(lower(section), 'e') AND contains(lower(section), 'n'))"""

# ---------------------------------------------------------------- vectors

TF = f"""
tok AS MATERIALIZED (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP}) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS MATERIALIZED (SELECT id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w FROM tf JOIN idf USING (term))"""

ORACLES["tokens"] = f"""
SELECT doc_id AS id, len({TOKENS}) AS n, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents"""
ORACLES["idf_table"] = f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["tfidf_weights"] = f"WITH {TF} SELECT id, term, round(w, 6) AS w FROM w"
ORACLES["sentence_split"] = r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM documents),
u AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS spos FROM s)
SELECT doc_id AS id, CAST(spos AS INT) AS spos, length(sentence) AS chars, md5(sentence) AS sentence_md5 FROM u"""

# ---------------------------------------------------------------- keywords

ORACLES["lexicon_match"] = f"SELECT doc_id AS id, unnest({HITS}) AS keyword FROM documents"
ORACLES["lexicon_words"] = f"""
WITH p AS (SELECT doc_id, ' ' || array_to_string({SPLIT % KEY}, ' ') || ' ' AS p FROM documents)
SELECT doc_id AS id, unnest(list_filter([{WORDS}], lambda k: contains(p, ' ' || k || ' '))) AS keyword FROM p"""
ORACLES["lexicon_table_join"] = f"""
WITH b AS (SELECT DISTINCT unnest({SPLIT % KEY}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({SPLIT % KEY}) AS w FROM documents)
SELECT doc_id AS id, count(*) AS n, min(w) AS first_keyword FROM d WHERE w IN (SELECT w FROM b) GROUP BY doc_id"""
ORACLES["pos_filter"] = f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS lemma, generate_subscripts({TOKENS}, 1) - 1 AS ordinal FROM documents)
SELECT doc_id AS id, count(*) AS n, count(DISTINCT lemma) AS n_lemmas, max(ordinal) AS last_ordinal
FROM t WHERE length(lemma) > 5 AND lemma NOT IN ({STOP}) GROUP BY doc_id"""
ORACLES["entity_filter"] = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+|\d+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+|\d+'), 1) - 1 AS ordinal FROM documents)
SELECT doc_id AS id, count(*) AS n, min(lower(t)) AS first_keyword, max(ordinal) AS last_ordinal FROM t WHERE NOT regexp_matches(t, '^[0-9]') GROUP BY doc_id"""

SPANS = "regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')"
KEPT = f"list_filter({TOKENS}, lambda w: w NOT IN ({STOP}))"
SIGNALS = f"""
sig AS (SELECT doc_id AS id, unnest({KEPT}) AS k, generate_subscripts({KEPT}, 1) AS o, 1.0 AS w, 1 AS s FROM documents
  UNION ALL SELECT doc_id, lower(unnest({SPANS})), generate_subscripts({SPANS}, 1), 2.0, 2 FROM documents
  UNION ALL SELECT doc_id, unnest({HITS}), generate_subscripts({HITS}, 1), 1.1, 4 FROM documents)"""

ORACLES["keyword_fusion"] = f"""
WITH {TF}, {SIGNALS},
top AS (SELECT id, term, round(w, 6) AS c FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 6) DESC, term) <= 5),
a AS (SELECT id, k, w FROM sig UNION ALL SELECT id, term, (c - 0.5) / 0.5 * 2 FROM top)
SELECT id, k AS keyword, round(sum(w), 6) AS score FROM a GROUP BY ALL HAVING round(sum(w), 6) > 1"""

ORACLES["keyword_ranking"] = f"""
WITH {SIGNALS},
g AS (SELECT id, k, round(sum(w), 6) AS score, min(s * 1000000 + o) AS place FROM sig GROUP BY ALL HAVING round(sum(w), 6) > 1),
l AS (SELECT id, list(k ORDER BY score DESC, place, k) AS ks FROM g GROUP BY id)
SELECT id, len(ks) AS n, ks[1] AS first_keyword, md5(array_to_string(ks, ',')) AS list_md5 FROM l"""

# ---------------------------------------------------------------- similarity and stories


def _story_sql(keywords: bool) -> str:
    shared = "len(list_intersect(x.kw, y.kw))" if keywords else "0"
    return f"""
{TF},
kw AS MATERIALIZED (SELECT doc_id AS id, source, {HITS if keywords else 'CAST([] AS VARCHAR[])'} AS kw FROM documents),
dots AS MATERIALIZED (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS c FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY ALL),
sims AS MATERIALIZED (SELECT x.id AS i, y.id AS j, coalesce(c, 0) AS c, {shared} AS k, x.source <> y.source AS differ,
  greatest(0, least(1, coalesce(c, 0) + 0.033 * {shared} + CASE WHEN x.source <> y.source THEN 0.1 ELSE -0.5 END)) AS sim
  FROM kw x JOIN kw y ON x.id < y.id LEFT JOIN dots d ON d.i = x.id AND d.j = y.id),
links AS MATERIALIZED (SELECT i AS a, j AS b FROM sims WHERE sim >= 0.9 - 1e-9 UNION ALL SELECT j, i FROM sims WHERE sim >= 0.9 - 1e-9),
reach AS (SELECT DISTINCT a AS id, a AS hub FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.hub = l.a),
comp AS MATERIALIZED (SELECT id, min(hub) AS story FROM reach GROUP BY id),
wgt AS MATERIALIZED (SELECT x.story, avg(sim) AS m FROM sims s JOIN comp x ON x.id = s.i JOIN comp y ON y.id = s.j WHERE x.story = y.story GROUP BY x.story),
siz AS (SELECT story, count(*) AS n_articles, count(DISTINCT source) AS n_sources FROM comp JOIN kw USING (id) GROUP BY story)"""


SHARED = """
held AS (SELECT story, k, count(*) AS n FROM (SELECT DISTINCT story, id, unnest(kw) AS k FROM comp JOIN kw USING (id)) GROUP BY ALL),
shk AS (SELECT held.story, k FROM held JOIN siz ON siz.story = held.story AND n = n_articles)"""
WEIGHT = "round_even(round(m, 9), 2)"

ORACLES["cross_source_story_clusters"] = f"""
WITH RECURSIVE {_story_sql(False)}
SELECT row_number() OVER (ORDER BY story) - 1 AS number, story, n_articles, n_sources, round(m, 6) AS mean_sim, {WEIGHT} AS similarity_weight
FROM wgt JOIN siz USING (story)"""

ORACLES["keyword_story_clusters"] = f"""
WITH RECURSIVE {_story_sql(True)}, {SHARED},
mem AS (SELECT story, string_agg(lang, '|||' ORDER BY doc_id) AS headlines, string_agg({URL}, '|||' ORDER BY doc_id) AS urls
        FROM comp JOIN documents d ON d.doc_id = comp.id GROUP BY story),
ks AS (SELECT story, string_agg(k, ',' ORDER BY k) AS keywords FROM shk GROUP BY story)
SELECT story, 0 AS part, headlines, urls, coalesce(keywords, '') AS keywords, {WEIGHT} AS similarity_weight
FROM wgt JOIN mem USING (story) LEFT JOIN ks USING (story)"""

ORACLES["shared_keywords"] = f"""
WITH RECURSIVE {_story_sql(True)}, {SHARED} SELECT story, k AS keyword FROM shk"""

ORACLES["adjusted_edges"] = f"""
WITH RECURSIVE {_story_sql(True)},
node AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {STREAM}) AS node FROM documents)
SELECT x.node AS i, y.node AS j, round(any_value(c), 6) AS cos, CAST(any_value(k) AS INT) AS shared,
  count(*) FILTER (differ) AS cross_pairs, count(*) FILTER (NOT differ) AS same_pairs,
  round(greatest(0, least(1, any_value(c) + 0.033 * any_value(k) + 0.1)), 6) AS sim_cross,
  round(greatest(0, least(1, any_value(c) + 0.033 * any_value(k) - 0.5)), 6) AS sim_same
FROM (SELECT least(p.node, q.node) AS ni, greatest(p.node, q.node) AS nj, sims.* FROM sims JOIN node p ON p.id = i JOIN node q ON q.id = j WHERE sim >= 0.9 - 1e-9) s
JOIN node x ON x.id = s.ni AND x.node = s.ni JOIN node y ON y.id = s.nj AND y.node = s.nj GROUP BY ALL"""

UNIT = """
u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
cs AS MATERIALIZED (SELECT x.id AS i, y.id AS j, x.label <> y.label AS differ, list_cosine_similarity(x.e, y.e) AS c FROM u x JOIN u y ON x.id < y.id)"""

ORACLES["embedding_edges"] = f"""
WITH {UNIT} SELECT i, j, round(c, 6) AS cos, 1 AS cross_pairs, round(c + 0.1, 6) AS sim_cross FROM cs WHERE differ AND c + 0.1 >= 0.5"""

ORACLES["embedding_stories"] = f"""
WITH RECURSIVE {UNIT},
links AS MATERIALIZED (SELECT i AS a, j AS b FROM cs WHERE differ AND c + 0.1 >= 0.5 UNION ALL SELECT j, i FROM cs WHERE differ AND c + 0.1 >= 0.5),
reach AS (SELECT DISTINCT a AS id, a AS hub FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.hub = l.a),
comp AS (SELECT id, min(hub) AS story FROM reach GROUP BY id),
m AS (SELECT x.story, avg(greatest(0, least(1, c + CASE WHEN differ THEN 0.1 ELSE -0.5 END))) AS m
      FROM cs JOIN comp x ON x.id = i JOIN comp y ON y.id = j AND y.story = x.story GROUP BY x.story),
s AS (SELECT story, count(*) AS n_articles, count(DISTINCT label) AS n_sources FROM comp JOIN u USING (id) GROUP BY story)
SELECT story, n_articles, n_sources, round(m, 6) AS mean_sim FROM m JOIN s USING (story)"""

LINKS35 = """links AS MATERIALIZED (SELECT i AS a, j AS b FROM cs WHERE c >= 0.35 UNION ALL SELECT j, i FROM cs WHERE c >= 0.35)"""

ORACLES["connected_components"] = f"""
WITH RECURSIVE {UNIT}, {LINKS35},
reach AS (SELECT DISTINCT a AS id, a AS hub FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.hub = l.a)
SELECT id AS node, min(hub) AS component FROM reach GROUP BY id"""

ORACLES["density_clusters"] = f"""
WITH RECURSIVE {UNIT}, {LINKS35},
core AS MATERIALIZED (SELECT a AS id FROM links GROUP BY a HAVING count(*) >= 2),
cl AS MATERIALIZED (SELECT a, b FROM links WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS hub FROM core UNION SELECT r.id, l.b FROM reach r JOIN cl l ON r.hub = l.a),
lab AS (SELECT id, min(hub) AS label FROM reach GROUP BY id)
SELECT id AS node, label, true AS core FROM lab
UNION ALL SELECT b, min(label), false FROM links JOIN lab ON lab.id = a WHERE b NOT IN (SELECT id FROM core) GROUP BY b"""

# ---------------------------------------------------------------- load

ORACLES["insert_if_absent"] = """
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""

ART = f"""
art AS (SELECT doc_id AS id, {URL} AS url, source, text, {DATE} AS date, {HITS} AS kw, {STREAM} AS key FROM documents),
grp AS (SELECT key, min(id) AS story, round(count(DISTINCT source) / count(*), 2) AS weight FROM art GROUP BY key HAVING count(*) > 1),
mem AS (SELECT story, weight, art.* FROM art JOIN grp USING (key)),
sk AS (SELECT DISTINCT story, unnest(kw) AS k FROM mem),
fresh AS (SELECT DISTINCT story FROM mem WHERE date >= DATE '2024-01-28')"""

ORACLES["normalised_tables"] = f"""
WITH {ART}, pg AS (SELECT DISTINCT url, {LANG} AS k FROM pages),
ak AS (SELECT DISTINCT url, k FROM (SELECT url, unnest(kw) AS k FROM art UNION ALL SELECT url, k FROM pg) WHERE k IS NOT NULL)
SELECT 'articles' AS name, (SELECT count(*) FROM art) + (SELECT count(*) FROM pg) AS n
UNION ALL SELECT 'keywords', (SELECT count(DISTINCT k) FROM ak)
UNION ALL SELECT 'junct_article_keywords', (SELECT count(*) FROM ak)
UNION ALL SELECT 'similar_articles', (SELECT count(*) FROM grp)
UNION ALL SELECT 'junct_simart_articles', (SELECT count(*) FROM mem)
UNION ALL SELECT 'junct_simart_keywords', (SELECT count(*) FROM sk)"""

ORACLES["article_keyword_junction"] = f"WITH {ART} SELECT DISTINCT url, unnest(kw) AS keyword FROM art"
ORACLES["story_keyword_junction"] = f"""
WITH {ART} SELECT url, count(*) AS n_keywords, min(k) AS first_keyword FROM mem JOIN sk USING (story) GROUP BY url"""
ORACLES["recent_strong_texts"] = f"""
WITH {ART} SELECT url, md5(text) AS content_md5 FROM mem WHERE weight >= 0.8 AND story IN (SELECT story FROM fresh) AND text <> ''"""
ORACLES["recent_strong_members"] = f"""
WITH {ART} SELECT url, CAST(date AS VARCHAR) AS date, source AS article_source FROM mem
WHERE weight >= 0.8 AND story IN (SELECT story FROM fresh) AND story IN (SELECT story FROM sk)"""
ORACLES["all_story_articles"] = f"WITH {ART} SELECT url, source AS article_source FROM mem"
ORACLES["story_corpus"] = f"WITH {ART} SELECT md5(text) AS content_md5, count(*) AS n FROM mem GROUP BY 1"

# ---------------------------------------------------------------- groups, digests, scores


def _cleaned(source: str) -> str:
    """From (grp, art, text) rows: cleaned texts, repeats dropped, groups of two and more."""
    return rf"""
raw AS ({source}),
c0 AS (SELECT grp, art, {PROSE} AS text FROM raw WHERE text IS NOT NULL),
c1 AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM c0 WHERE lower(text) <> 'nan' AND trim(regexp_replace(text, '\s', ' ', 'g')) <> ''),
cln AS MATERIALIZED (SELECT grp, art, text FROM c1 WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY grp, lower(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) ORDER BY art) = 1)"""


TALK = "SELECT conv_id AS grp, turn AS art, text FROM conversations"

ORACLES["clean_groups"] = f"WITH {_cleaned(TALK)} SELECT grp AS conv_id, art AS turn, md5(text) AS text_md5 FROM cln"
ORACLES["dedup_texts_ci"] = f"""
WITH {_cleaned("SELECT source AS grp, doc_id AS art, text || '  ' AS text FROM documents UNION ALL SELECT source, -doc_id - 1, lower(text) FROM documents")}
SELECT art AS id FROM cln"""
ORACLES["grouped_texts"] = """
SELECT conv_id, 0 AS part, count(*) AS n, md5(string_agg(text, '<doc-sep>' ORDER BY turn)) AS joined_md5 FROM conversations GROUP BY conv_id"""

# Longest common subsequence by thresholds: t[k] is the shortest beginning of the one text that has k letters in common, in order, with
# what was read of the other. A letter moves every t[k] to its next place after t[k - 1], if that is nearer, and may add one.
NEAR_PAIRS = _cleaned("""SELECT conv_id AS grp, turn AS art, text FROM conversations UNION ALL
  SELECT conv_id, turn + 1000, CASE WHEN length(text) > 600 THEN regexp_replace(text, '((?:[^ ]+ ){2})[^ ]+ ', '\\1', 'g')
         ELSE regexp_replace(text, '((?:[^ ]+ ){4})[^ ]+ ', '\\1', 'g') END FROM conversations""") + """,
q AS (SELECT a.grp, a.art AS i, b.art AS j, a.text AS x, b.text AS y, length(a.text) AS n, length(b.text) AS m
      FROM cln a JOIN cln b ON a.grp = b.grp AND a.art < b.art AND a.text <> b.text AND 200 * least(length(a.text), length(b.text)) > 85 * (length(a.text) + length(b.text))),
u AS (SELECT DISTINCT grp, i, x, n FROM q),
h AS (SELECT grp, i, n, unnest(range(1, n + 1)) AS p, substring(x, p, 1) AS ch FROM u),
e AS (SELECT u.grp, u.i, d.ch, unnest(range(0, u.n + 1)) AS p FROM u JOIN (SELECT DISTINCT grp, i, ch FROM h) d ON d.grp = u.grp AND d.i = u.i),
f AS (SELECT e.grp, e.i, e.ch, e.p, min(h.p) OVER (PARTITION BY e.grp, e.i, e.ch ORDER BY e.p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx
      FROM e LEFT JOIN h ON h.grp = e.grp AND h.i = e.i AND h.p = e.p AND h.ch = e.ch),
g AS (SELECT grp, i, ch, list(coalesce(nx, 1000000000)::INTEGER ORDER BY p) AS nx FROM f GROUP BY grp, i, ch),
z AS MATERIALIZED (SELECT grp, i, map_from_entries(list((ch, nx))) AS nx FROM g GROUP BY grp, i),
t(grp, i, j, step, t) USING KEY (grp, i, j) AS (
  SELECT grp, i, j, 0, []::INTEGER[] FROM q
  UNION
  SELECT grp, i, j, step + 1, CASE WHEN nx IS NULL THEN t ELSE list_transform(range(1, len(t) + 1), lambda k: least(t[k], nx[CASE WHEN k = 1 THEN 1 ELSE t[k - 1] + 1 END]))
         || list_filter([nx[CASE WHEN len(t) = 0 THEN 1 ELSE t[len(t)] + 1 END]], lambda v: v < 1000000000) END
  FROM (SELECT t.*, z.nx[substring(q.y, step + 1, 1)] AS nx FROM t JOIN q USING (grp, i, j) JOIN z USING (grp, i) WHERE step < m)),
np AS (SELECT grp, i, j, n, m, 200.0 * len(t) / (n + m) AS ratio FROM t JOIN q USING (grp, i, j) WHERE 200 * len(t) > 85 * (n + m))"""

ORACLES["near_pairs_in_talks"] = f"""
WITH RECURSIVE {NEAR_PAIRS}
SELECT grp AS conv_id, i AS first_turn, j AS second_turn, round(ratio, 6) AS ratio FROM np"""

ORACLES["near_repeats_in_talks"] = f"""
WITH RECURSIVE {NEAR_PAIRS},
gone AS (SELECT grp, i AS art FROM np WHERE n <= m UNION SELECT grp, j FROM np WHERE m <= n)
SELECT cln.grp AS conv_id, cln.art AS turn, gone.art IS NOT NULL AS gone FROM cln LEFT JOIN gone ON gone.grp = cln.grp AND gone.art = cln.art"""

SCORED = rf"""
tok AS (SELECT grp, art, unnest({TOKENS}) AS term FROM cln),
tf AS (SELECT grp, art, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP}) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM cln)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT grp, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY grp, art)) AS w FROM tf JOIN idf USING (term)),
cen AS MATERIALIZED (SELECT w.grp, term, sum(w) / any_value(n) AS w FROM w JOIN (SELECT grp, count(*) AS n FROM cln GROUP BY grp) s ON s.grp = w.grp GROUP BY ALL),
ss AS (SELECT grp, art, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM cln),
sen AS MATERIALIZED (SELECT grp, art, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS spos FROM ss),
st AS (SELECT grp, art, spos, unnest({TOKENS}) AS term FROM sen),
sw AS MATERIALIZED (SELECT grp, art, spos, term, count(*) * any_value(idf) AS w FROM st JOIN idf USING (term) WHERE term NOT IN ({STOP}) GROUP BY ALL),
nrm AS (SELECT grp, art, spos, sqrt(sum(w * w)) AS n FROM sw GROUP BY ALL),
cn AS (SELECT grp, sqrt(sum(w * w)) AS n FROM cen GROUP BY grp),
sc AS MATERIALIZED (SELECT sen.grp, sen.art, sen.spos, sen.text, round(coalesce(d / (nrm.n * cn.n), 0), 6) AS score
  FROM sen LEFT JOIN (SELECT sw.grp, art, spos, sum(sw.w * cen.w) AS d FROM sw JOIN cen ON cen.grp = sw.grp AND cen.term = sw.term GROUP BY ALL) x
    ON x.grp = sen.grp AND x.art = sen.art AND x.spos = sen.spos
  LEFT JOIN nrm ON nrm.grp = sen.grp AND nrm.art = sen.art AND nrm.spos = sen.spos LEFT JOIN cn ON cn.grp = sen.grp)"""
CENTER = _cleaned(TALK) + "," + SCORED

ORACLES["centroid_terms"] = f"WITH {CENTER} SELECT grp AS conv_id, term, round(w, 6) AS w FROM cen"
ORACLES["centroid_scores"] = f"WITH {CENTER} SELECT grp AS conv_id, art AS turn, CAST(spos AS INT) AS spos, score FROM sc"
PICKED = """
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, art, spos) AS r FROM sc),
sn AS MATERIALIZED (SELECT rk.grp, r, term, w / n AS w FROM sw JOIN nrm USING (grp, art, spos) JOIN rk USING (grp, art, spos)),
cf AS MATERIALIZED (SELECT grp, r, list(q) AS qs FROM (SELECT a.grp, a.r, b.r AS q FROM sn a JOIN sn b ON a.grp = b.grp AND a.term = b.term AND b.r < a.r
  GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.7) GROUP BY ALL),
pick AS (SELECT grp, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS got FROM (SELECT DISTINCT grp FROM rk)
  UNION ALL SELECT p.grp, rk.r, CASE WHEN len(p.got) < 3 AND NOT list_has_any(coalesce(cf.qs, []), p.got) THEN list_append(p.got, rk.r) ELSE p.got END
  FROM pick p JOIN rk ON rk.grp = p.grp AND rk.r = p.r + 1 LEFT JOIN cf ON cf.grp = rk.grp AND cf.r = rk.r),
fin AS (SELECT grp, unnest(got) AS r FROM (SELECT grp, arg_max(got, r) AS got FROM pick GROUP BY grp))"""

ORACLES["extractive_summary"] = f"""
WITH RECURSIVE {CENTER},{PICKED}
SELECT rk.grp AS conv_id, string_agg(text, ' ' ORDER BY art, spos) AS summary FROM fin JOIN rk ON rk.grp = fin.grp AND rk.r = fin.r GROUP BY rk.grp"""

# stories by all pairs, their strong and fresh ones with a keyword that all members hold, and the digest of each
STRONG = f"""
WITH RECURSIVE {_story_sql(True)}, {SHARED},
strong AS (SELECT story FROM wgt WHERE {WEIGHT} >= 0.8 AND story IN (SELECT story FROM shk)
  AND story IN (SELECT story FROM comp WHERE {DATE.replace('doc_id', 'id')} >= CAST({ASOF} AS DATE) - 2))
SELECT story, id FROM comp WHERE story IN (SELECT story FROM strong)"""
MEMBERS = f"SELECT story AS grp, md5({URL}) AS art, nullif(trim(text), '') AS text FROM member JOIN documents ON doc_id = id"
ORACLES["daily_run"] = f"""
WITH RECURSIVE member AS MATERIALIZED ({STRONG}), {_cleaned(MEMBERS)},{SCORED},{PICKED},
sm AS (SELECT rk.grp, string_agg(text, ' ' ORDER BY art, spos) AS summary FROM fin JOIN rk ON rk.grp = fin.grp AND rk.r = fin.r GROUP BY rk.grp)
SELECT min({URL}) AS first_url, md5(any_value(summary)) AS summary_md5 FROM sm JOIN member ON story = grp JOIN documents ON doc_id = id GROUP BY grp"""

ORACLES["abstractive_summary"] = f"""
WITH {_cleaned(TALK)}, f AS (SELECT grp, string_agg(split_part(text, ' ', 1), ' ' ORDER BY art) AS summary FROM cln GROUP BY grp)
SELECT DISTINCT conv_id, coalesce(summary, 'No content to summarize.') AS summary FROM conversations LEFT JOIN f ON grp = conv_id"""


def _grams(rows: str) -> str:
    """Distinct bigrams of (conv_id, text) rows."""
    return rf"""SELECT DISTINCT conv_id, unnest(list_transform(range(1, len(ws)), lambda n: ws[n] || ' ' || ws[n + 1])) AS g FROM
  (SELECT conv_id, flatten(list_transform(list_filter(string_split(text, '.'), lambda p: length(p) > 0),
     lambda p: string_split(trim(regexp_replace(p, '\s+', ' ', 'g')), ' '))) AS ws FROM ({rows}))"""


ALL_TEXTS = "SELECT conv_id, string_agg(text, ' [DOC_SEP] ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
LONGEST = "SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1"
FIRST = "SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"


def _rouge(name: str, rows: str) -> str:
    return f"""
{name}_h AS ({_grams(rows)}),
{name}_n AS (SELECT r.conv_id, (SELECT count(*) FROM {name}_h h WHERE h.conv_id = r.conv_id) AS c, (SELECT count(*) FROM refs f WHERE f.conv_id = r.conv_id) AS r,
  (SELECT count(*) FROM {name}_h h JOIN refs f ON f.conv_id = h.conv_id AND f.g = h.g WHERE h.conv_id = r.conv_id) AS o FROM (SELECT DISTINCT conv_id FROM conversations) r),
{name}_p AS (SELECT conv_id, CASE WHEN c = 0 THEN 0.0 ELSE o / c END AS p, CASE WHEN r = 0 THEN 0.0 ELSE o / r END AS q FROM {name}_n),
{name} AS (SELECT conv_id, round(p, 6) AS p, round(q, 6) AS q, round(2 * (p * q / (p + q + 1e-8)), 6) AS f FROM {name}_p)"""


ORACLES["rouge2"] = f"""
WITH refs AS MATERIALIZED ({_grams(ALL_TEXTS)}), {_rouge("a", LONGEST)}
SELECT conv_id, p AS rouge2_precision, q AS rouge2_recall, f AS rouge2_f1 FROM a"""
ORACLES["rouge2_compare"] = f"""
WITH refs AS MATERIALIZED ({_grams(ALL_TEXTS)}), {_rouge("a", LONGEST)}, {_rouge("b", FIRST)}
SELECT a.conv_id, a.p AS rouge2_precision_1, a.q AS rouge2_recall_1, a.f AS rouge2_f1_1,
       b.p AS rouge2_precision_2, b.q AS rouge2_recall_2, b.f AS rouge2_f1_2 FROM a JOIN b USING (conv_id) ORDER BY conv_id LIMIT 5"""

ORACLES["embed_texts"] = """
SELECT doc_id AS id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents"""

# ---------------------------------------------------------------- streams

ORACLES["stream_first_seen"] = "SELECT DISTINCT user_id, event_type FROM events"
ORACLES["stream_load"] = f"""
SELECT {URL} AS url, len({HITS}) AS n_keywords FROM documents WHERE len({HITS}) > 0"""
