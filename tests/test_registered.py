"""Registered queries against their SQL twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = [
    "union_sources_by_name", "clean_text", "normalize_dates", "keyword_strings", "title_filters", "first_seen_listing",
    "sections_until_word", "sections_through_word", "sections_until_repeat", "last_wins_section", "section_exclusion",
    "page_body_text", "page_body_by_source", "page_headline", "page_links", "page_lead_image", "tokens", "idf_table",
    "tfidf_weights", "sentence_split", "lexicon_match", "lexicon_words", "lexicon_table_join", "pos_filter", "entity_filter",
    "keyword_fusion", "keyword_ranking", "cross_source_story_clusters", "adjusted_edges", "embedding_edges", "insert_if_absent",
    "clean_groups", "dedup_texts_ci", "grouped_texts", "centroid_scores", "extractive_summary", "rouge2", "abstractive_summary",
    "stream_first_seen", "listing_cards", "listing_articles", "near_pairs_in_talks"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(plain(r[n]) for n in order) for r in rows), key=str)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"}
    assert own - set(entry.oracle_sql()) == {"story_digests", "near_repeats_in_stories"}


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
