"""Registered queries: (spark, folder) → DataFrame over the whole tables of that folder.

Stand-ins: an article is a row of ``documents`` with
``url = https://<source>.example.org/<doc_id>`` and
``date = 2024-01-01 + doc_id mod 30 days``; "now" is 2024-01-30.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import FreshParams, StoryParams, SummaryParams
from ..functions import dates as D, html as H, text as T
from ..operators import cards as E, clusters as C, components as G, groups as R, keywords as K, listing as L, load as N
from ..operators import pages as P, rouge as Q, similarity as S, summary as Z, vectors as V
from ..runtime import cut, dealt, scratch_path, spread, table, together
from ..sources import files as I
from ..sources.tables import Tables, new_rows
from ..streaming import ingest as X
from .daily import daily_run as run_day
from .stories import find_dense_stories, find_stories, unique_articles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def as_of() -> Column:
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text", "lang", "n_chars")


def _url() -> Column:
    return F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("id").cast("string"))


def _date() -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(30)).cast("int"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


def _dealt_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages in small tasks, for queries that make several of each."""
    return dealt(table(spark, folder, "pages"), 512)


def _r(c, places: int = 6) -> Column:
    return F.round(c, places)


# ---------------------------------------------------------------- sources

@query
def csv_round_trip(spark, folder):
    docs = _docs(spark, folder).select("source", F.lit("all").alias("section"), F.lit(None).cast("string").alias("section_url"),
                                       F.col("text").alias("title"), _url().alias("url"), _date().cast("string").alias("date"),
                                       F.lit(None).cast("string").alias("image"), F.col("lang").alias("subheading"))
    path = scratch_path(spark, "articles-csv")
    I.write_by_source(docs, path)
    return I.scan_articles(spark, path).select("source", "section", "title", "url", "date", "subheading")


@query
def union_sources_by_name(spark, folder):
    docs = _docs(spark, folder).select("source", _url().alias("url"), F.col("lang").alias("section"), F.col("n_chars").alias("size"))
    pages = _pages(spark, folder).select("url", F.lit("web").alias("source"))
    talk = table(spark, folder, "conversations").select(
        F.length("text").cast("bigint").alias("size"), F.concat_ws("/", "conv_id", "turn").alias("url"), F.col("role").alias("source"))
    return I.union_sources([docs, pages, talk]).select("source", "url", "section", F.coalesce("size", F.lit(-1)).alias("size"))


# ---------------------------------------------------------------- text, dates, arrays

@query
def clean_text(spark, folder):
    text = F.col("text")
    return spread(_docs(spark, folder)).select(
        "id",
        F.md5(T.ascii_only(text).cast("binary")).alias("ascii_md5"),
        F.length(T.keep_prose_marks(text)).alias("prose_chars"),
        F.md5(T.headline_key(text).cast("binary")).alias("key_md5"),
        F.size(T.words(text)).alias("n_words"),
        T.count_of(text, "-").alias("dashes"),
        F.length(T.digits(text)).alias("n_digits"),
        T.is_missing_text(text).alias("missing"))


@query
def normalize_dates(spark, folder):
    rows = table(spark, folder, "events")
    kind = F.col("event_type")
    n = F.pmod("user_id", F.lit(23)).cast("string")
    raw = (
        F.when(kind == "error", F.concat(n, F.lit(" hours ago")))
        .when(kind == "click", F.concat(n, F.lit(" days ago")))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .when(kind == "purchase", F.lit("garbage"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    short = F.when(kind == "error", F.concat(F.lit("updated "), n, F.lit("h ago"))).when(
        kind == "click", F.concat(n, F.lit("m ago"))).otherwise(F.upper(F.date_format("ts", "MMM dd")))
    spaced = F.when(kind == "error", F.concat(n, F.lit("h ago"))).when(
        kind == "click", F.date_format("ts", "MMM. d, yyyy")).when(kind == "view", F.date_format("ts", "MMMM d yyyy")).otherwise(
        F.concat(n, F.lit("d ago")))
    day = lambda c: c.cast("date").cast("string")
    return rows.select(
        "event_id", day(D.parse_or(raw, as_of())).alias("parsed"), day(D.spelled_ago(raw, as_of())).alias("spelled"),
        D.short_ago(short, as_of()).cast("string").alias("short"), day(D.spaced_ago(spaced, as_of())).alias("spaced"))


@query
def keyword_strings(spark, folder):
    """Keyword lists as exports write them, read back, cleaned and joined again."""
    docs = spread(_docs(spark, folder))
    words = F.array_distinct(T.tokens(F.col("text")))
    literal = F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), " , "), F.lit("]"))
    marked = T.join_list(words)
    return docs.select(
        "id", F.md5(T.join_list(T.parse_list_literal(literal), ",").cast("binary")).alias("parsed_md5"),
        F.size(T.split_list(marked, T.ARRAY_MARK)).alias("n_split"), F.size(T.split_list(F.lit(""), ",")).alias("n_empty"))


# ---------------------------------------------------------------- listings

def _listing(spark, folder) -> DataFrame:
    """Every page as a listing row of every source."""
    pages = P.page_fields(_pages(spark, folder))
    slug = F.lower(F.regexp_replace("headline", "[^A-Za-z0-9]+", "-"))
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return pages.select(
        F.explode(F.array(*(F.lit(s) for s in L.LISTING_RULES))).alias("source"), F.col("page_id").alias("pos"),
        F.coalesce("language", F.lit("")).alias("section"), F.col("headline").alias("title"),
        F.concat(host, F.lit("/"), slug).alias("url"),
        F.concat(F.lit("Newsroom •  "), F.col("page_title")).alias("subheading"))


@query
def title_filters(spark, folder):
    rows = L.keep_articles(L.tidy(_listing(spark, folder)))
    return rows.select("source", F.col("pos").alias("page_id"), "title", "subheading")


@query
def first_seen_listing(spark, folder):
    """Rows as scrolling finds them: each conversation turn again under its role."""
    talk = table(spark, folder, "conversations").select(
        F.explode(F.array(*(F.lit(s) for s in L.LISTING_RULES))).alias("source"), F.col("role").alias("section"),
        F.concat(F.lit("https://talk.example.org/"), F.col("conv_id").cast("string")).alias("url"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return L.first_seen(talk).select("source", "section", "url", "pos")


@query
def first_seen_url(spark, folder):
    """One row per text, the earliest: exact repeats of a key, keep first."""
    rows = _docs(spark, folder).select("source", F.md5(F.col("text").cast("binary")).alias("url"), "id", F.col("lang").alias("title"))
    return unique_articles(rows, "id").select("source", "url", F.col("id").alias("first_id"))


def _nav(spark, folder) -> DataFrame:
    """The words of each text as navigation entries, one menu per document and source."""
    docs = together(_docs(spark, folder).select(F.concat_ws("/", "source", "id").alias("menu"), "text"), "menu")
    return docs.select("menu", F.posexplode(T.words(F.col("text"))).alias("pos", "section")).select(
        "menu", "pos", "section", F.concat(F.lit("https://nav.example.org/"), F.col("pos").cast("string")).alias("url"))


@query
def sections_until_word(spark, folder):
    out = L.sections_until(_nav(spark, folder), L.SectionRule(stop_word="of"), ["menu"])
    return out.groupBy("menu").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query
def sections_through_word(spark, folder):
    out = L.sections_until(_nav(spark, folder), L.SectionRule(stop_word="que", stop_inclusive=True), ["menu"])
    return out.groupBy("menu").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query
def sections_until_repeat(spark, folder):
    out = L.sections_until(_nav(spark, folder), L.SectionRule(stop_at_repeat=True), ["menu"])
    return out.groupBy("menu").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query
def last_wins_section(spark, folder):
    out = L.last_wins(_nav(spark, folder), ["menu"])
    return out.groupBy("menu").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.max("url").alias("max_url"))


@query
def section_exclusion(spark, folder):
    links = P.page_links(_pages(spark, folder), "page_id").select("page_id", "pos", F.col("text").alias("section"), F.col("href").alias("url"))
    rule = L.SectionRule(skip_url_part="th", skip_names=("", " ", "of", "and"), skip_name_parts=("e", "n"))
    return links.where(~L.excluded_section(rule)).select("page_id", "pos", "section")


# ---------------------------------------------------------------- pages

@query
def page_body_text(spark, folder):
    out = P.page_bodies(_pages(spark, folder))
    return out.select("page_id", F.length("body").alias("chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query
def page_body_by_source(spark, folder):
    """Every page as every source would serve it; paywalled and unknown ones have no body."""
    wrap = {
        "FOX": ('<div class="article-body"><div>x</div>', "</div>"), "NPR": ('<div id="storytext">', "</div>"),
        "AP": ('<div class="Page-content">', "</div>"), "CBS": ('<section class="content__body">', "</section>"),
        "NYT": ("<article>", "</article>"), "OTHER": ("<article>", "</article>")}
    pages = _dealt_pages(spark, folder)
    source = F.explode(F.array(*(F.lit(s) for s in wrap))).alias("source")
    rows = pages.select("page_id", "html", source)
    html = F.col("html")
    for name, (before, after) in wrap.items():
        html = F.when(F.col("source") == name, F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit(before)),
                                                         F.lit("</article>"), F.lit(after))).otherwise(html)
    out = rows.select("page_id", "source", html.alias("html")).withColumn("body", P.body_by_source(F.col("source"), F.col("html")))
    return out.select("page_id", "source", F.coalesce(F.length("body"), F.lit(-1)).alias("chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


# a listing card of each source, made of a link of the page: $1 is its target, $2 its text
CARDS = {
    "FOX": """<article><a href="/$1"><img src="https://i.example.org/$1.png"></a><div><a href="/s">S</a><span class="time">3 hours ago</span></div>
              <h4><a href="/$1">$2 for the day</a></h4></article>""",
    "WAPO": """<DIV data-feature-id='homepage/story'><div><a href="/$1-a-b-c"><span data-qa="card-title">$2 of this day\n now</span></a></div>
               <p>About $2</p><img src=https://i.example.org/$1.png></DIV>""",
    "NYT": """<li><article><a class="x" href='/$1'><h3>$2 one two three</h3></a><p>About $2</p></article>
              <div><span data-testid="todays-date">Jan. 5, 2024</span></div></li>""",
    "AP": """<div class="PageList-items-item"><picture><source srcset="https://i.example.org/$1.png"></picture><a href="/$1">
             <span class="x PagePromoContentIcons-text">$2</span></a><span class="PagePromoContentIcons-text">About $2</span></div>""",
    "NPR": """<article class="item big has-image"><picture><img src="https://i.example.org/$1.png"></picture><h2 class="title"><a href=/$1>$2</a></h2>
              <p class="teaser"><a href="/$1"><time datetime="2024-01-05T22:00:00-05:00">Jan 5</time> • About $2</a></p></article>""",
    "HuffPost": """<div class="js-card zone card"><a href="/$1"><img src="https://i.example.org/$1.png"></a><div class="card__text">
                   <h3 class="card__headline__text">Opinion: $2 one two three</h3><div class="card__description">About $2</div></div></div>""",
    "CBS": """<article class="item"><a href="/$1"><h4 class="item__hed">$2</h4><p class="item__dek">About $2</p><span class="item__date">26h ago</span></a></article>""",
}


def _cards(spark, folder) -> DataFrame:
    """Every page as a listing of every source: each link of its navigation is a card, AP's after two segments of its head."""
    pages = _dealt_pages(spark, folder).select(
        "page_id", F.col("url").alias("section_url"), F.lit("front").alias("section"), "html", F.explode(F.array(*(F.lit(s) for s in CARDS))).alias("source"))
    html = F.col("html")
    for name, card in CARDS.items():
        html = F.when(F.col("source") == name, F.regexp_replace("html", '<li><a href="/([^"]*)">([^<]*)</a></li>', card)).otherwise(html)
    head = '<ul class="PageList-items"><li class="PageList-items-item"><a href="/head"><b class="PagePromoContentIcons-text">head</b></a></li></ul>'
    held = F.when(F.col("source") == "AP", F.regexp_replace(html, "(?s)<ul>(.*?)</ul>", f'{head}{head}<div class="PageList-items">$1</div>')).otherwise(html)
    return E.listing_cards(pages.withColumn("html", held), as_of())


@query
def listing_cards(spark, folder):
    out = _cards(spark, folder)
    return out.select("page_id", "source", "section", "pos", "title", "url", F.col("date").cast("string").alias("date"), "image", "subheading")


@query
def listing_articles(spark, folder):
    """The cards that count as articles, tidied, each once as its source counts."""
    rows = _cards(spark, folder).withColumn("pos", F.struct("page_id", "pos"))
    out = L.first_seen(L.keep_articles(L.tidy(rows)))
    return out.select("page_id", "source", F.col("pos.pos").alias("pos"), "title", "url", "subheading")


@query
def page_headline(spark, folder):
    return P.page_fields(_pages(spark, folder)).select(
        "page_id", "headline", "page_title", "subheading", "published", "first_link", "language")


@query
def page_links(spark, folder):
    return P.page_links(_pages(spark, folder), "page_id")


@query
def page_lead_image(spark, folder):
    """The link targets of each page served as images."""
    html = F.regexp_replace("html", '<a href="/([^"]*)">', '<img alt="" src="https://static.example.org/$1"><img src="https://face.example.org/$1">')
    pages = _pages(spark, folder).select("page_id", F.explode(F.array(F.lit("FOX"), F.lit("CNN"), F.lit("AP"))).alias("source"),
                                         F.replace(html, F.lit("static.example.org/t"), F.lit("img.example.org/t")).alias("html"))
    return P.lead_images(pages).select("page_id", "source", "image")


# ---------------------------------------------------------------- vectors

@query
def tokens(spark, folder):
    words = T.tokens(F.col("text"))
    return spread(_docs(spark, folder)).select("id", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("tokens_md5"))


@query
def idf_table(spark, folder):
    docs = together(_docs(spark, folder), "id")
    path = scratch_path(spark, "vocabulary")
    V.save_vocabulary(V.idf_table(V.term_counts(docs, ["id"]), docs.select(F.count("*")).scalar()), path)
    return V.load_vocabulary(spark, path).select("term", "df", _r("idf").alias("idf"))


@query
def tfidf_weights(spark, folder):
    vecs = V.tfidf(together(_docs(spark, folder), "id"), "id")
    return vecs.select("id", F.inline("vec")).select("id", "term", _r("w").alias("w"))


@query
def sentence_split(spark, folder):
    rows = _docs(spark, folder).select(F.lit(0).alias("group"), F.col("id").alias("article"), "text")
    return Z.split_sentences(spread(rows)).select(
        F.col("article").alias("id"), F.col("spos").cast("int").alias("spos"), F.length("sentence").alias("chars"),
        F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


# ---------------------------------------------------------------- keywords

@query
def lexicon_match(spark, folder):
    return K.lexicon_match(spread(_docs(spark, folder))).select("id", "keyword")


@query
def lexicon_words(spark, folder):
    return K.lexicon_match(spread(_docs(spark, folder)), mode="word").select("id", "keyword")


@query
def lexicon_table_join(spark, folder):
    """A lexicon kept as a table: the words of the benchmark texts."""
    bench = table(spark, folder, "benchmark").select(F.explode(T.words(T.headline_key(F.col("text")))).alias("keyword"))
    return K.lexicon_join(spread(_docs(spark, folder)), bench).groupBy("id").agg(F.count("*").alias("n"), F.min("keyword").alias("first_keyword"))


def _annotated(spark, folder) -> DataFrame:
    """Tokens tagged by a rule (length) in place of a tagger."""
    rows = together(_docs(spark, folder), "id").select("id", F.posexplode(T.tokens(F.col("text"))).alias("ordinal", "lemma"))
    tag = F.when(F.length("lemma") > 8, "PROPN").when(F.length("lemma") > 5, "NOUN").when(F.length("lemma") > 3, "VERB").otherwise("DET")
    return rows.withColumn("pos", tag).withColumn("is_stop", F.col("lemma").isin(*K.STOP_WORDS))


@query
def pos_filter(spark, folder):
    kept = K.keep_pos(_annotated(spark, folder))
    return kept.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("lemma").alias("n_lemmas"), F.max("ordinal").alias("last_ordinal"))


@query
def entity_filter(spark, folder):
    spans = spread(_docs(spark, folder)).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+|\d+"), F.lit(0))).alias("ordinal", "text"))
    label = F.when(F.col("text").rlike("^[0-9]{4}$"), "DATE").when(F.col("text").rlike("^[0-9]"), "CARDINAL").otherwise("ORG")
    return K.keep_entities(spans.withColumn("label", label)).groupBy("id").agg(
        F.count("*").alias("n"), F.min("keyword").alias("first_keyword"), F.max("ordinal").alias("last_ordinal"))


def _signals(spark, folder) -> DataFrame:
    docs = together(_docs(spark, folder), "id")
    vecs = V.tfidf(docs, "id")
    return (K.word_signal(docs).unionByName(K.span_signal(docs)).unionByName(K.vector_signal(vecs))
            .unionByName(K.lexicon_signal(docs)))


@query
def keyword_fusion(spark, folder):
    return K.fuse_keywords(_signals(spark, folder)).select("id", "keyword", "score")


@query
def keyword_ranking(spark, folder):
    """How many keywords each text has and which leads, from counts and lexicon alone."""
    docs = together(_docs(spark, folder), "id")
    ranked = K.fuse_keywords(K.word_signal(docs).unionByName(K.span_signal(docs)).unionByName(K.lexicon_signal(docs)))
    lists = K.keyword_lists(ranked)
    return lists.select("id", F.size("keywords").alias("n"), F.col("keywords")[0].alias("first_keyword"),
                        F.md5(F.array_join("keywords", ",").cast("binary")).alias("list_md5"))


# ---------------------------------------------------------------- similarity and stories

def _with_lexicon(spark, folder) -> DataFrame:
    """Written: copies are folded and vectors made of it, and the lexicon is tried once on a text."""
    return cut(spread(_docs(spark, folder)).withColumn("keywords", K.lexicon_hits(F.col("text"))))


@query
def cross_source_story_clusters(spark, folder):
    found = find_stories(_docs(spark, folder))
    return C.number_stories(found.weights).select(
        "number", "story", "n_articles", "n_sources", _r("mean_sim").alias("mean_sim"),
        C.weight_of("mean_sim").alias("similarity_weight"))


@query
def keyword_story_clusters(spark, folder):
    """The same with the keyword bonus: an export row per story."""
    found = find_stories(_with_lexicon(spark, folder), keyword_col="keywords")
    docs = _docs(spark, folder).select("id", _url().alias("url"), F.col("lang").alias("title"))
    out = C.cluster_table(found.weights, found.rows().join(docs, "id").select("story", "id", "url", "title"), found.keywords())
    return out.select("story", "part", T.join_list(F.col("headlines")).alias("headlines"), T.join_list(F.col("urls")).alias("urls"),
                      T.join_list(F.col("keywords"), ",").alias("keywords"), "similarity_weight")


@query
def shared_keywords(spark, folder):
    return find_stories(_with_lexicon(spark, folder), keyword_col="keywords").keywords()


@query
def adjusted_edges(spark, folder):
    """Pairs of distinct texts (i = j: copies of one) with how many article pairs they stand for."""
    params = StoryParams()
    docs = _with_lexicon(spark, folder)
    members = S.fold_copies(docs, keyword_col="keywords")
    nodes = S.story_nodes(docs, members, params, keyword_col="keywords")
    out = S.adjusted_edges(nodes, S.node_sources(members), params)
    return out.select("i", "j", _r("cos").alias("cos"), F.col("shared").cast("int").alias("shared"), F.col("cross").cast("bigint").alias("cross_pairs"),
                      F.col("same").cast("bigint").alias("same_pairs"), _r("sim_cross").alias("sim_cross"), _r("sim_same").alias("sim_same"))


EMBEDDING_PARAMS = StoryParams(threshold=0.5)


@query
def embedding_edges(spark, folder):
    """Labels stand for sources; the bound is lowered to 0.5 because no two vectors come near 0.8."""
    items = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"), "embedding")
    members, nodes = S.fold_vectors(items)
    out = S.dense_edges(nodes, S.node_sources(members), EMBEDDING_PARAMS)
    return out.select("i", "j", _r("cos").alias("cos"), F.col("cross").cast("bigint").alias("cross_pairs"), _r("sim_cross").alias("sim_cross"))


@query
def embedding_stories(spark, folder):
    items = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("source"), "embedding")
    found = find_dense_stories(items, EMBEDDING_PARAMS)
    return found.weights.select("story", "n_articles", "n_sources", _r("mean_sim").alias("mean_sim"))


def _embedding_links(spark, folder) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return cut(S.dense_pairs(rows, 0.35).select("i", "j"))


@query
def connected_components(spark, folder):
    return G.components(_embedding_links(spark, folder))


@query
def density_clusters(spark, folder):
    return G.dbscan(_embedding_links(spark, folder), min_samples=3)


# ---------------------------------------------------------------- load

def _collected(spark, folder) -> DataFrame:
    docs = spread(_docs(spark, folder))
    return docs.select(F.col("id").alias("pos"), "source", F.col("lang").alias("section"), F.lit(None).cast("string").alias("section_url"),
                       F.concat_ws(" ", F.lit("story"), "id").alias("title"), _url().alias("url"), _date().alias("date"),
                       F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("subheading"),
                       K.lexicon_hits(F.col("text")).alias("keywords"), "text", "id")


def _copy_stories(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that occur more than once, as stories: weight = sources / articles."""
    keyed = cut(rows.select("id", "url", "source", "keywords", F.md5(T.token_stream(F.col("text")).cast("binary")).alias("key")))
    found = keyed.groupBy("key").agg(F.min("id").alias("story"), F.count("*").alias("n"), F.countDistinct("source").alias("m")).where("n > 1")
    links = cut(keyed.join(found, "key").select("story", "url", "keywords"))
    keys = N.story_keys(links)
    words = links.select("story", F.explode("keywords").alias("keyword")).distinct()
    return (found.join(keys, "story").select("simart_id", F.round(F.col("m") / F.col("n"), 2).alias("similar_weight")),
            links.join(keys, "story").select("simart_id", "url"), words.join(keys, "story").select("simart_id", "keyword"))


def _loaded(spark, folder) -> tuple[Tables, DataFrame]:
    rows = cut(_collected(spark, folder))
    tables = Tables(spark, scratch_path(spark, "tables"))
    N.load_day(tables, "day-1", rows, _copy_stories(rows))
    return tables, rows


@query
def insert_if_absent(spark, folder):
    """Orders against customers who already have a priority order: only the new customers come in, first order each."""
    orders = table(spark, folder, "orders")
    known = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    out = new_rows(orders.select("o_custkey", "o_orderkey", "o_totalprice"), known, ["o_custkey"], "o_orderkey")
    return out.select("o_custkey", "o_orderkey", _r("o_totalprice", 2).alias("o_totalprice"))


@query
def normalised_tables(spark, folder):
    """Two runs over the same rows and one over the pages: rows per table afterwards."""
    tables, rows = _loaded(spark, folder)
    N.load_day(tables, "day-2", rows, _copy_stories(rows))
    pages = P.page_fields(_pages(spark, folder)).select(
        F.col("page_id").alias("pos"), F.lit("web").alias("source"), F.col("language").alias("section"),
        F.lit(None).cast("string").alias("section_url"), F.col("headline").alias("title"), "url", as_of().cast("date").alias("date"),
        F.lit(None).cast("string").alias("image"), "subheading", F.array(F.col("language")).alias("keywords"))
    N.load_day(tables, "day-3", pages)
    names = ("articles", "keywords", "junct_article_keywords", "similar_articles", "junct_simart_articles", "junct_simart_keywords")
    return I.union_sources([tables.read(n).groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


@query
def article_keyword_junction(spark, folder):
    tables, _ = _loaded(spark, folder)
    out = tables.read("junct_article_keywords").join(tables.read("articles"), "article_id").join(tables.read("keywords"), "keyword_id")
    return out.select("url", "keyword")


@query
def story_keyword_junction(spark, folder):
    tables, _ = _loaded(spark, folder)
    out = tables.read("junct_simart_keywords").join(tables.read("keywords"), "keyword_id").join(
        tables.read("junct_simart_articles"), "simart_id").join(tables.read("articles"), "article_id")
    return out.groupBy("url").agg(F.count("*").alias("n_keywords"), F.min("keyword").alias("first_keyword"))


@query
def recent_strong_texts(spark, folder):
    tables, rows = _loaded(spark, folder)
    N.insert_bodies(tables, "bodies-1", rows.select(N.key_of("url").alias("article_id"), F.nullif("text", F.lit("")).alias("article_content")))
    out = N.texts_to_summarise(tables.read("similar_articles"), tables.read("junct_simart_articles"), tables.read("articles"),
                               tables.read("article_text"), as_of().cast("date"))
    return out.join(tables.read("articles").select("article_id", "url"), "article_id").select(
        "url", F.md5(F.col("article_content").cast("binary")).alias("content_md5"))


@query
def recent_strong_members(spark, folder):
    """To be read in full: only stories that have a keyword."""
    tables, _ = _loaded(spark, folder)
    out = N.strong_fresh_members(tables.read("similar_articles"), tables.read("junct_simart_articles"), tables.read("articles"),
                                 as_of().cast("date"), FreshParams(), tables.read("junct_simart_keywords"), tables.read("keywords"))
    return out.select("url", F.col("date").cast("string").alias("date"), "article_source")


@query
def all_story_articles(spark, folder):
    tables, _ = _loaded(spark, folder)
    return N.all_story_articles(tables.read("similar_articles"), tables.read("junct_simart_articles"), tables.read("articles")).select(
        "url", "article_source")


@query
def story_corpus(spark, folder):
    tables, rows = _loaded(spark, folder)
    N.insert_bodies(tables, "bodies-1", rows.select(N.key_of("url").alias("article_id"), F.col("text").alias("article_content")))
    out = N.story_corpus(tables.read("junct_simart_articles"), tables.read("article_text"))
    return out.groupBy(F.md5(F.col("article_content").cast("binary")).alias("content_md5")).agg(F.count("*").alias("n"))


@query
def daily_run(spark, folder):
    """From the documents as articles, and as pages, to the stored summaries, run a second time to the same tables."""
    tables = Tables(spark, scratch_path(spark, "daily"))
    rows = _collected(spark, folder).drop("id").withColumn("date", F.col("date").cast("string"))
    marked = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = rows.select("url", F.concat(F.lit("<nav>x</nav><article><p>"), marked, F.lit("</p></article>")).alias("html"))
    for _ in range(2):
        run_day(tables, "day-1", rows, pages, as_of().cast("date"), body=lambda source, html: P.rule_body(html, P.PLAIN_ARTICLE))
    first = tables.read("junct_simart_articles").join(tables.read("articles"), "article_id").groupBy("simart_id").agg(F.min("url").alias("first_url"))
    return tables.read("similar_article_summaries").join(first, "simart_id").select("first_url", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


# ---------------------------------------------------------------- groups, digests, scores

def _talks(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("group"), F.col("turn").alias("article"), "text")


@query
def clean_groups(spark, folder):
    out = R.clean_groups(_talks(spark, folder))
    return out.select(F.col("group").alias("conv_id"), F.col("article").alias("turn"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def dedup_texts_ci(spark, folder):
    """All documents of a source as one group: later repeats go."""
    rows = _docs(spark, folder).select(F.xxhash64("source").alias("group"), F.col("id").alias("article"), F.concat("text", F.lit("  ")).alias("text"))
    return R.clean_groups(rows.unionByName(rows.select("group", (-F.col("article") - 1).alias("article"), F.lower("text").alias("text")))).select(
        F.col("article").alias("id"))


@query
def grouped_texts(spark, folder):
    out = R.grouped_texts(_talks(spark, folder))
    return out.select(F.col("group").alias("conv_id"), "part", F.size("texts").alias("n"),
                      F.md5(F.array_join("texts", T.DOC_SEPARATOR).cast("binary")).alias("joined_md5"))


@query
def centroid_terms(spark, folder):
    out = Z.centroids(R.clean_groups(_talks(spark, folder)))
    return out.select(F.col("group").alias("conv_id"), "term", _r("w").alias("w"))


@query
def centroid_scores(spark, folder):
    out = Z.scored_sentences(R.clean_groups(_talks(spark, folder)))
    return out.select(F.col("group").alias("conv_id"), F.col("article").alias("turn"), F.col("spos").cast("int").alias("spos"),
                      "score")


@query
def extractive_summary(spark, folder):
    out = Z.extractive_summary(cut(R.clean_groups(_talks(spark, folder))))
    return out.select(F.col("group").alias("conv_id"), "summary")


@query
def story_digests(spark, folder):
    """Digest of every story found among the documents, near repeats dropped first."""
    docs = _docs(spark, folder)
    found = find_stories(docs)
    texts = found.rows().join(docs.select("id", "text"), "id").select(F.col("story").alias("group"), F.col("id").alias("article"), "text")
    texts = R.drop_near_repeats(cut(R.clean_groups(texts)))
    return Z.extractive_summary(texts, SummaryParams(sentences=5)).select(F.col("group").alias("story"), "summary")


def _edited_talks(spark, folder) -> DataFrame:
    """Each turn and an edit of it without every fifth word, longer ones without every third."""
    talks = _talks(spark, folder)
    few = F.regexp_replace("text", "((?:[^ ]+ ){4})[^ ]+ ", "$1")
    more = F.regexp_replace("text", "((?:[^ ]+ ){2})[^ ]+ ", "$1")
    return talks.unionByName(talks.select("group", (F.col("article") + 1000).alias("article"), F.when(F.length("text") > 600, more).otherwise(few).alias("text")))


@query
def near_repeats_in_talks(spark, folder):
    """Pairs above the bound and what goes, among the turns of each conversation and their edits."""
    texts = cut(R.clean_groups(_edited_talks(spark, folder)))
    gone = R.near_repeats(texts).withColumn("gone", F.lit(True))
    return texts.join(gone, ["group", "article"], "left").select(
        F.col("group").alias("conv_id"), F.col("article").alias("turn"), F.coalesce("gone", F.lit(False)).alias("gone"))


@query
def near_pairs_in_talks(spark, folder):
    out = R.near_pairs(cut(R.clean_groups(_edited_talks(spark, folder))))
    return out.select(F.col("group").alias("conv_id"), F.col("i").alias("first_turn"), F.col("j").alias("second_turn"), _r("ratio").alias("ratio"))


@query
def near_repeats_in_stories(spark, folder):
    docs = _docs(spark, folder)
    found = find_stories(docs)
    texts = found.rows().join(docs.select("id", "text"), "id").select(F.col("story").alias("group"), F.col("id").alias("article"), "text")
    return R.near_repeats(cut(R.clean_groups(texts))).select(F.col("group").alias("story"), F.col("article").alias("id"))


def _last_turns(spark, folder) -> DataFrame:
    """The longest turn of each conversation, as a summary to be scored."""
    return _talks(spark, folder).groupBy("group").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("article"))).alias("summary"))


@query
def rouge2(spark, folder):
    out = Q.rouge2(_last_turns(spark, folder), _talks(spark, folder))
    return out.select(F.col("group").alias("conv_id"), _r("rouge2_precision").alias("rouge2_precision"),
                      _r("rouge2_recall").alias("rouge2_recall"), _r("rouge2_f1").alias("rouge2_f1"))


@query
def rouge2_compare(spark, folder):
    """Two methods on the first five groups: the longest turn against the first."""
    talks = _talks(spark, folder)
    first = talks.groupBy("group").agg(F.min_by("text", "article").alias("summary"))
    out = Q.compare_methods(_last_turns(spark, folder), first, talks)
    return out.select(F.col("group").alias("conv_id"), *(_r(c).alias(c) for c in out.columns if c.startswith("rouge2")))


def _stub_summarizer():
    return lambda texts: " ".join(t.split(" ")[0] for t in texts)


@query
def abstractive_summary(spark, folder):
    """The model hook with a stub: the first word of each text; groups emptied by cleaning get the fixed message."""
    talks = _talks(spark, folder)
    out = Z.abstractive_summary(R.clean_groups(talks), _stub_summarizer, groups=talks)
    return out.select(F.col("group").alias("conv_id"), "summary")


def _stub_embedder():
    return lambda texts: pd.Series([[float(len(t)), float(t.count(" "))] for t in texts])


@query
def embed_texts(spark, folder):
    """The encoder hook with a stub: number of characters and of blanks."""
    out = K.embed(spread(_docs(spark, folder)), _stub_embedder)
    return out.select("id", F.col("embedding")[0].cast("bigint").alias("chars"), F.col("embedding")[1].cast("bigint").alias("blanks"))


# ---------------------------------------------------------------- streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query
def stream_first_seen(spark, folder):
    rows = X.landing_stream(spark, f"{folder}/events.parque[t]", EVENTS).select("user_id", "event_type")
    path = scratch_path(spark, "first-seen")
    X.first_seen_into(rows, ["user_id", "event_type"], path, path + "-progress").awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(path).select("user_id", "event_type")


@query
def stream_load(spark, folder):
    """Documents landing as files, loaded per micro-batch: keywords per article afterwards."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = X.landing_stream(spark, f"{folder}/documents.parque[t]", schema).withColumnRenamed("doc_id", "id")
    rows = rows.select(F.col("id").alias("pos"), "source", F.col("lang").alias("section"), F.lit(None).cast("string").alias("section_url"),
                       F.concat_ws(" ", F.lit("story"), "id").alias("title"), _url().alias("url"), _date().alias("date"),
                       F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("subheading"),
                       K.lexicon_hits(F.col("text")).alias("keywords"))
    tables = Tables(spark, scratch_path(spark, "stream-tables"))
    X.load_available(rows, tables, scratch_path(spark, "stream-progress")).awaitTermination()
    return tables.read("junct_article_keywords").join(tables.read("articles"), "article_id").groupBy("url").agg(F.count("*").alias("n_keywords"))
