import datetime as dt

from pyspark.sql import functions as F

from storyflow.functions import dates as D, html as H, text as T

def as_of():
    return F.lit("2025-03-10 12:00:00").cast("timestamp")


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("y")).first().y


def test_clean_up(spark):
    assert one(spark, "café naïve—x²", T.ascii_only) == "caf navex"
    assert one(spark, "café naïve—x² (y)!", T.keep_prose_marks) == "café naïvex² y"
    assert one(spark, "a   b", T.keep_prose_marks) == "a  b"
    for bad in (None, "nan", "NaN", "", " \n "):
        assert one(spark, bad, T.is_missing_text) is True
    assert one(spark, "It's U.S. time!", T.headline_key) == "it's us time"
    assert one(spark, " a\tb  c ", T.words) == ["a", "b", "c"]
    assert one(spark, "", T.words) == []


def test_tokens_follow_the_pattern(spark):
    import regex

    text = "-Foo bar-baz- -- a--b x café_1 'n -9-!"
    expected = regex.findall(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?", text.lower())
    assert one(spark, text, T.tokens) == expected
    assert one(spark, "The cat is on it", lambda c: T.tokens(c, ["the", "is", "on", "it"])) == ["cat"]


def test_lists(spark):
    assert one(spark, "", T.split_list) == []
    assert one(spark, "a,b", T.split_list) == ["a", "b"]
    assert one(spark, "a|||b", lambda c: T.split_list(c, "|||")) == ["a", "b"]
    assert one(spark, "['a' , 'b',\"it's\"]", T.parse_list_literal) == ["a", "b", "its"]
    assert one(spark, "x • Sub head", T.after_bullet) == "Sub head"
    assert one(spark, "Life+Style", lambda c: T.section_name(c, F.lit("Food"))) == "Life Style/Food"
    row = spark.createDataFrame([(["", "b"],), (["a", "b", "c"],), ([],)], "x array<string>")
    assert [r.y for r in row.select(T.third_link_text(F.col("x")).alias("y")).collect()] == ["b", "c", None]


def test_numbers(spark):
    rows = spark.createDataFrame([(0.4,), (0.5,), (0.75,), (1.0,)], "c double")
    assert [round(r.y, 6) for r in rows.select(T.model_score(F.col("c")).alias("y")).collect()] == [-0.4, 0.0, 1.0, 2.0]
    rows = spark.createDataFrame([(-0.2,), (0.3,), (1.7,)], "c double")
    assert [r.y for r in rows.select(T.clip_unit(F.col("c")).alias("y")).collect()] == [0.0, 0.3, 1.0]


def test_dates_one_by_one(spark):
    day = dt.date
    parse = lambda v: one(spark, v, lambda c: D.parse_or(c, as_of()))
    assert parse("2025-01-05") == day(2025, 1, 5)
    assert parse("2025-01-05 10:11:12") == day(2025, 1, 5)
    assert parse("2025-01-05T10:11:12-05:00") == day(2025, 1, 5)
    assert parse("garbage") == parse(None) == day(2025, 3, 10)


def test_relative_dates(spark):
    day = dt.date
    spelled = lambda v: one(spark, v, lambda c: D.spelled_ago(c, as_of()))
    assert spelled("3 hours ago") == day(2025, 3, 10) and spelled("13 hours ago") == day(2025, 3, 9)
    assert spelled("1 day ago") == day(2025, 3, 9) and spelled("2 years ago") == day(2023, 3, 10)
    assert spelled("soon") == day(2025, 3, 10)
    short = lambda v: one(spark, v, lambda c: D.short_ago(c, as_of()))
    assert short("5m ago") == dt.datetime(2025, 3, 10, 11, 55) and short("updated 2h ago") == dt.datetime(2025, 3, 10, 10)
    assert short("3d ago") == dt.datetime(2025, 3, 7, 12) and short("JAN 06") == dt.datetime(2025, 1, 6)
    spaced = lambda v: one(spark, v, lambda c: D.spaced_ago(c, as_of()))
    assert spaced("5m ago") == day(2025, 3, 10) and spaced("2d ago") == day(2025, 3, 8)
    for form in ("Jan. 5, 2025", "January 5, 2025", "Jan. 5 2025", "January 5 2025"):
        assert spaced(form) == day(2025, 1, 5)
    assert spaced("garbage") == spaced(None) == day(2025, 3, 10)


def test_paragraphs(spark):
    html = "<p>a <b>x</b>&amp;<p class='k'>b</p><script>var t='</p>';</script><pre>no</pre><p>c"
    assert one(spark, html, lambda c: H.paragraphs(H.without_scripts(c))) == ["a x&", "b", "c"]


def test_balanced_container(spark):
    html = '<div>o</div><div id="t">1<div>2<div>3</div></div>4</div>5'
    assert one(spark, html, lambda c: H.inner(H.first_element(c, H.by_attribute("id", "t")))) == "1<div>2<div>3</div></div>4"
    assert one(spark, '<div id="t">1<div>2', lambda c: H.inner(H.first_element(c, H.by_attribute("id", "t")))) == "1<div>2"
    assert one(spark, '<div id="t"></div>x', lambda c: H.inner(H.first_element(c, H.by_attribute("id", "t")))) == ""
    assert one(spark, "<p>x</p>", lambda c: H.inner(H.first_element(c, H.by_attribute("id", "t")))) is None


def test_references_images_and_written_days(spark):
    from storyflow.functions import dates, html

    text = "caf&eacute; &#8212; it&rsquo;s &#x41;&amp;lt; R&D &nosuch; &#0; a&nbsp;b &"
    assert spark.range(1).select(html.plain(F.lit(text))).first()[0] == "café — it’s A&lt; R&D &nosuch; &#0; a b &"
    page = '<IMG alt=x><img class="a" data-src="no" src="one.png"><!-- <img src="old"> --><img src=\'two.png\'><img src=three.png>'
    found = spark.range(1).select(html.images(html.without_scripts(F.lit(page)))).first()[0]
    assert found == ["", "one.png", "two.png", "three.png"]
    rows = spark.createDataFrame([("2025-01-05T23:11:12-05:00",), ("2025-01-05T00:30:00+09:00",), ("2025-01-05 10:11",), ("soon",), (None,)], "d string")
    as_of = F.lit("2025-02-02").cast("timestamp")
    assert [str(r[0]) for r in rows.select(dates.parse_or(F.col("d"), as_of)).collect()] == ["2025-01-05"] * 3 + ["2025-02-02"] * 2
