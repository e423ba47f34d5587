"""The daily run: broken after every stage and inside stages, it ends with the tables of an unbroken one."""

import pytest
from pyspark.sql import functions as F

from storyflow.config import FreshParams
from storyflow.operators import pages as P
from storyflow.plans.daily import STAGES, collected, daily_run, plain_keywords
from storyflow.sources.tables import KEYS, Tables

RAW = ("pos long, source string, section string, section_url string, title string, url string, date string, image string, subheading string, "
       "keywords array<string>, text string")


class Broken(Exception):
    pass


def as_of():
    return F.lit("2024-01-30").cast("date")


def inputs(spark):
    storm = "A storm hit the coast on Monday. Many houses were lost. Help is on its way."
    vote = "The council voted on the new budget. It passed with a small margin."
    rows = [
        (1, "FOX", storm, "2024-01-29"), (2, "NPR", storm + " More rain is expected.", "2024-01-29"), (3, "CBS", storm, "no date"),
        (4, "FOX", vote, "2024-01-02"), (5, "NPR", vote, "2024-01-02"), (6, "AP", "Something else altogether happened far away.", "2024-01-30")]
    articles = [(n, s, "front", None, f"title {n}", f"https://{s}/{n}", d, None, None, ["Storm", "café"] if t.startswith(storm) else ["Budget"], t) for n, s, t, d in rows]
    articles += [(7, "AP", "front", None, None, "https://AP/7", None, None, None, None, storm), (8, "FOX", "x", None, "again", "https://FOX/1", None, None, None, ["Late"], vote)]
    pages = [(f"https://{s}/{n}", f"<article><p>{t}</p></article>" if n != 3 else "<p>no body</p>") for n, s, t, _ in rows]
    return spark.createDataFrame(articles, RAW), spark.createDataFrame(pages, "url string, html string")


def run(tables, articles, pages, **more):
    return daily_run(tables, "day", articles, pages, as_of(), fresh=FreshParams(min_weight=0.3), body=lambda s, h: P.rule_body(h, P.PLAIN_ARTICLE), **more)


def contents(tables):
    return {name: sorted(map(tuple, tables.read(name).collect()), key=str) for name in KEYS}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    tables = Tables(spark, str(tmp_path_factory.mktemp("whole")))
    made = run(tables, *inputs(spark))
    return contents(tables), sorted(map(tuple, made.collect()))


def test_unbroken_run(spark, whole):
    tables, made = whole
    assert len(tables["articles"]) == 7 and len(tables["similar_articles"]) == 2 and len(tables["junct_simart_articles"]) == 5
    assert sorted(k for _, k in tables["keywords"]) == ["Budget", "Late", "Storm", "caf"]
    assert len(tables["article_text"]) == 2  # one page of the fresh story has no body; the old story is not read
    assert tables["similar_article_summaries"] == made and len(made) == 1 and "storm" in made[0][1]


def test_run_broken_after_every_stage_goes_on(spark, tmp_path, whole):
    tables, seen = Tables(spark, str(tmp_path)), []
    articles, pages = inputs(spark)

    def after(stage):
        seen.append(stage)
        raise Broken(stage)

    for stage in STAGES:
        with pytest.raises(Broken, match=stage):
            run(tables, articles, pages, after=after)
    assert tuple(seen) == STAGES
    run(tables, articles.limit(0), pages.limit(0), after=after)  # all is entered: nothing is read or done again
    assert contents(tables) == whole[0]


def test_run_broken_inside_a_stage_leaves_nothing_and_goes_on(spark, tmp_path, whole, monkeypatch):
    tables, insert = Tables(spark, str(tmp_path)), Tables.insert
    articles, pages = inputs(spark)
    for name in ("junct_simart_articles", "article_text", "similar_article_summaries"):
        def broken(self, table, *rest, at=name, **more):
            insert(self, table, *rest, **more)
            if table == at:
                raise Broken(at)

        monkeypatch.setattr(Tables, "insert", broken)
        with pytest.raises(Broken, match=name):
            run(tables, articles, pages)
        assert tables.read(name).count() == 0  # written, but not entered
        monkeypatch.setattr(Tables, "insert", insert)
    run(tables, articles, pages)
    assert contents(tables) == whole[0]


def test_days_and_keywords(spark):
    rows = spark.createDataFrame([("2024-01-05T23:00:00-05:00", ["é", "café", "caf", " "]), ("junk", None), (None, [])], "date string, keywords array<string>")
    got = collected(rows, as_of()).withColumn("keywords", plain_keywords(F.col("keywords"))).collect()
    assert [(str(r.date), r.keywords) for r in got] == [("2024-01-05", ["caf"]), ("2024-01-30", None), ("2024-01-30", [])]
