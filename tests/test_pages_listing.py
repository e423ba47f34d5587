from pyspark.sql import functions as F

from storyflow.operators import listing as L, pages as P

COLS = "source string, section string, title string, url string, subheading string, pos int"


def test_bodies_by_source(spark):
    rows = [
        ("FOX", '<div class="article-body"><p class="x">ad</p><p>a</p><div><p>b</p></div></div><p>out</p>'),
        ("FOX", '<div class="article-body"><p class="speakable">a</p><p>b</p></div>'),
        ("FOX", '<div class="article-body"></div>'),
        ("AP", '<div class="Page-content"><p>z</p></div>'),
        ("AP", '<bsp-story-page><p>y</p></bsp-story-page><div class="Page-content"><p>z</p></div>'),
        ("CNN", '<p data-component-name="paragraph">a</p><p>no</p><p data-component-name="paragraph">b</p>'),
        ("NPR", "<p>no container</p>"), ("NYT", "<p>paid</p>"), ("???", "<p>a</p>"), ("CBS", None)]
    out = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, source string, html string").withColumn(
        "body", P.body_by_source(F.col("source"), F.col("html"))).orderBy("n").collect()
    assert [r.body for r in out] == ["a b", "a b", None, "z", "y", "a b", None, None, None, None]


def test_lead_images(spark):
    img = lambda *s: "".join(f'<img alt="" src="{u}">' for u in s)
    rows = [("FOX", img("https://a/1", "https://static.x/2", "https://a/3")), ("FOX", img("https://a/1")), ("FOX", ""),
            ("CNN", img("http://a/1", "https://a/face", "https://a/2")), ("AP", img("https://a/1", "https://a/2"))]
    out = P.lead_images(spark.createDataFrame(rows, "source string, html string")).collect()
    assert [r.image for r in out] == ["https://a/3", None, None, "https://a/2", None]


def test_listing_filters(spark):
    rows = [
        ("FOX", "s", "A quiz for you", "https://x/1", None, 1), ("FOX", "s", "News", "https://www.foxnews.com/video/1", None, 2),
        ("FOX", "s", "News", None, None, 3), ("FOX", "s", "News", "https://x/2", None, 4), ("FOX", "s", None, "https://x/3", None, 5),
        ("CNN", "s", "one two three", "https://x/a-b-c-d", None, 6), ("CNN", "s", "one two three", "https://x/a-b-c", None, 7),
        ("WAPO", "s", "one two\n three four", "a-b-c-d", None, 8), ("WAPO", "s", "one two three", "a-b-c-d", None, 9),
        ("NYT", "s", "a b c", "u", None, 10), ("NYT", "s", "a b c d", "u", None, 11),
        ("AP", "s", "  ", "u", " ", 12), ("AP", "s", "t", "u", "  ", 13),
        ("NPR", "s", "t", "u", "May 1 • Sub", 14), ("HuffPost", "s", "Opinion: a b c", "u", None, 15),
        ("HuffPost", "s", "Opinion: a b c d", "u", None, 16), ("CBS", "s", "t", None, None, 17)]
    out = L.keep_articles(L.tidy(spark.createDataFrame(rows, COLS))).collect()
    by = {r.pos: r for r in out}
    assert sorted(by) == [4, 6, 8, 11, 13, 14, 16, 17]
    assert by[8].title == "one two three four" and by[13].subheading is None
    assert by[14].subheading == "Sub" and by[16].title == "a b c d"


def test_first_seen_scopes(spark):
    rows = [(s, sec, "t", "u", None, n * 10 + k) for n, s in enumerate(("NYT", "NPR", "CNN")) for k, sec in enumerate(("a", "b", "a"))]
    out = sorted(r.pos for r in L.first_seen(spark.createDataFrame(rows, COLS)).collect())
    assert out == [0, 10, 11, 20, 21, 22]


def test_sections(spark):
    nav = lambda source, *names: [(source, n, name, f"https://n/{n}") for n, name in enumerate(names)]
    rows = (nav("FOX", "US", "World", "US", "Food") + nav("CNN", "US", "World", "US", "About us", "More")
            + nav("AP", "US", "Religion", "More") + nav("NYT", "", "Games", "US") + nav("HuffPost", "2024 Elections", "Life", "X")
            + nav("CBS", "Sports", "US"))
    out = L.sections(spark.createDataFrame(rows, "source string, pos int, section string, url string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.source, r.pos)):
        got.setdefault(r.source, []).append((r.section, r.url[-1]))
    assert got == {"FOX": [("US", "0"), ("World", "1")], "CNN": [("US", "2"), ("World", "1")],
                   "AP": [("US", "0"), ("Religion", "1")], "NYT": [("US", "2")], "CBS": [("US", "1")]}


def test_page_tasks_do_not_grow_with_a_file(spark, tmp_path):
    from storyflow.plans.queries import _dealt_pages

    pages = spark.range(5000).selectExpr("id AS page_id", "concat('https://a.example.org/', id) AS url", "'<p>x</p>' AS html")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = _dealt_pages(spark, str(tmp_path))
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 5000 and max(sizes) <= 600
