import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyflow.operators import load as N
from storyflow.operators.listing import keep_first
from storyflow.plans.stories import unique_articles
from storyflow.runtime import scratch_path
from storyflow.sources import files as I
from storyflow.sources.tables import Tables, new_rows
from storyflow.streaming import ingest as X

RAW = ("pos long, source string, section string, section_url string, title string, url string, date date, image string, "
       "subheading string, keywords array<string>")


def raw(spark, *rows):
    return spark.createDataFrame([(n, s, "sec", None, t, u, dt.date(2025, 3, d), None, None, kw) for n, (s, t, u, d, kw) in enumerate(rows)], RAW)


def names(tables, name, col):
    return sorted(r[0] for r in tables.read(name).select(col).collect())


def test_new_rows(spark):
    batch = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 3), (3, "d", 4)], "k int, v string, pos int")
    old = spark.createDataFrame([(2, "old")], "k int, v string")
    assert sorted((r.k, r.v) for r in new_rows(batch, old, ["k"], "pos").collect()) == [(1, "b"), (3, "d")]
    assert new_rows(batch, old.limit(0), ["k"], "pos").count() == 3
    assert sorted(r.v for r in keep_first(batch, ["k"], "pos").collect()) == ["b", "c", "d"]


def test_load_twice_and_grow(spark):
    tables = Tables(spark, scratch_path(spark, "tables"))
    day = raw(spark, ("A", "t1", "u1", 9, ["war", "Rome"]), ("A", "dup", "u1", 9, ["late"]), ("B", "t2", "u2", 9, ["it's", "", "[x]"]))
    stories = spark.createDataFrame([(["u1", "u2", "gone"], ["WAR ", "nope"], 0.9)], "urls array<string>, keywords array<string>, similar_weight double")
    N.load_day(tables, "1", day, N.stories_from_lists(stories))
    N.load_day(tables, "1", day, N.stories_from_lists(stories))
    N.load_day(tables, "2", day, N.stories_from_lists(stories))
    assert names(tables, "articles", "title") == ["t1", "t2"]
    assert names(tables, "keywords", "keyword") == ["Rome", "its", "late", "war", "x"]
    assert tables.read("junct_article_keywords").count() == 5
    assert tables.read("similar_articles").count() == 1
    assert tables.read("junct_simart_articles").count() == 2      # the unknown url joins nothing
    assert tables.read("junct_simart_keywords").count() == 1
    # collected again with another keyword: the article stays, the keyword is added
    N.load_day(tables, "3", raw(spark, ("A", "changed", "u1", 10, ["new"])))
    assert names(tables, "articles", "title") == ["t1", "t2"] and "new" in names(tables, "keywords", "keyword")
    assert tables.read("junct_article_keywords").count() == 6


def test_uncommitted_load_is_invisible_and_repeatable(spark):
    tables = Tables(spark, scratch_path(spark, "tables"))
    day = raw(spark, ("A", "t1", "u1", 9, ["war"]))
    tables.insert("articles", N.article_rows(day), "1", "pos")      # and then the job dies
    assert tables.read("articles").count() == 0
    N.load_day(tables, "1", day)
    assert tables.read("articles").count() == 1


def test_fresh_and_strong(spark):
    art = spark.createDataFrame([("a", dt.date(2025, 3, 9)), ("b", dt.date(2025, 3, 1)), ("c", dt.date(2025, 3, 1)), ("d", dt.date(2025, 3, 9))], "article_id string, date date")
    stories = spark.createDataFrame([("s1", 0.9), ("s2", 0.9), ("s3", 0.7), ("s4", 0.8)], "simart_id string, similar_weight double")
    links = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", "s3"), ("d", "s4")], "article_id string, simart_id string")
    kws = spark.createDataFrame([("s1", "k1"), ("s1", "k2")], "simart_id string, keyword_id string")
    as_of = F.lit("2025-03-10").cast("date")
    rows = lambda df: sorted((r.simart_id, r.article_id) for r in df.collect())
    assert rows(N.strong_fresh_members(stories, links, art, as_of)) == [("s1", "a"), ("s1", "b"), ("s4", "d")]
    assert rows(N.strong_fresh_members(stories, links, art, as_of, story_keywords=kws)) == [("s1", "a"), ("s1", "b")]
    text = spark.createDataFrame([("a", "x")], "article_id string, article_content string")
    assert rows(N.texts_to_summarise(stories, links, art, text, as_of)) == [("s1", "a")]


def test_bodies_without_text_stay_open(spark):
    tables = Tables(spark, scratch_path(spark, "tables"))
    schema = "article_id string, article_content string"
    N.insert_bodies(tables, "b1", spark.createDataFrame([("a", None), ("b", "x")], schema))
    N.insert_bodies(tables, "b2", spark.createDataFrame([("a", "later"), ("b", "y")], schema))
    assert sorted(map(tuple, tables.read("article_text").collect())) == [("a", "later"), ("b", "x")]
    N.insert_summaries(tables, "s1", spark.createDataFrame([("s", "text")], "simart_id string, summary string"))
    assert tables.read("similar_article_summaries").count() == 1


def test_story_key_depends_on_members_only(spark):
    a = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3")], "story long, url string")
    b = spark.createDataFrame([(7, "u2"), (7, "u1"), (8, "u1")], "story long, url string")
    ka = {r.story: r.simart_id for r in N.story_keys(a).collect()}
    kb = {r.story: r.simart_id for r in N.story_keys(b).collect()}
    assert ka[1] == kb[7] and len({ka[1], ka[2], kb[8]}) == 3


def test_csv_scan_skips_results_and_empty_files(spark, tmp_path):
    (tmp_path / "fox.csv").write_text('source,title,url\nFOX,"a ""b"", c\nd",u1\n')
    (tmp_path / "articles.csv").write_text("source,title,url\nOLD,t,u2\n")
    (tmp_path / "empty.csv").write_text("\n")
    out = I.scan_articles(spark, str(tmp_path), "source string, title string, url string").collect()
    assert [tuple(r) for r in out] == [("FOX", 'a "b", c\nd', "u1")]


def test_union_by_name_and_unique(spark):
    a = spark.createDataFrame([("A", "t", "u", 1)], "source string, title string, url string, pos int")
    b = spark.createDataFrame([(0, "u", "B"), (2, "v", "B")], "pos int, url string, source string")
    both = I.union_sources([a, b])
    assert both.columns == ["source", "title", "url", "pos"] and both.count() == 3
    assert [r.title for r in unique_articles(both).collect()] == ["t"]    # rows without a title are out


def test_first_seen_stream_over_batches(spark):
    folder = scratch_path(spark, "landing")
    row = "url string, ts timestamp"
    for day, urls in (("2025-03-01", ["a", "b", "a"]), ("2025-03-02", ["b", "c"]), ("2025-03-20", ["z"]), ("2025-03-21", ["a"])):
        spark.createDataFrame([(u, dt.datetime.fromisoformat(day)) for u in urls], row).coalesce(1).write.mode("append").parquet(folder)
        seen = X.first_seen_stream(X.landing_stream(spark, folder, row), ["url"], "ts")
        X.write_available(seen, folder + "-out", folder + "-progress").awaitTermination()
    out = sorted((r.url, str(r.ts.date())) for r in spark.read.parquet(folder + "-out").collect())
    assert out == [("a", "2025-03-01"), ("a", "2025-03-21"), ("b", "2025-03-01"), ("c", "2025-03-02"), ("z", "2025-03-20")]


def test_first_seen_for_good_does_not_depend_on_batches(spark):
    folder = scratch_path(spark, "landing")
    row = "url string, n int"
    days = [["a", "b", "a"], ["b", "c"], ["z"], ["a", "c", "d"]]
    for n, urls in enumerate(days):
        spark.createDataFrame([(u, n) for u in urls], row).coalesce(1).write.mode("append").parquet(folder)
        X.first_seen_into(X.landing_stream(spark, folder, row), ["url"], folder + "-out", folder + "-progress").awaitTermination()
    X.first_seen_into(X.landing_stream(spark, folder, row), ["url"], folder + "-once", folder + "-progress-once").awaitTermination()
    many, once = ({r.url for r in spark.read.parquet(folder + end).collect()} for end in ("-out", "-once"))
    assert many == once == {"a", "b", "c", "d", "z"}
    assert sorted((r.url, r.n) for r in spark.read.parquet(folder + "-out").collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 3), ("z", 2)]


def test_stream_load_is_incremental(spark):
    folder = scratch_path(spark, "landing")
    tables = Tables(spark, scratch_path(spark, "tables"))
    for batch in ([("A", "t1", "u1", 9, ["war"])], [("A", "again", "u1", 9, ["war"]), ("B", "t2", "u2", 9, [])]):
        raw(spark, *batch).coalesce(1).write.mode("append").parquet(folder)
        X.load_available(X.landing_stream(spark, folder, RAW), tables, folder + "-progress").awaitTermination()
    assert names(tables, "articles", "title") == ["t1", "t2"]


def test_cluster_needs_a_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(Exception):
        spark.read.parquet(scratch_path(spark, "nothing-here")).count()
