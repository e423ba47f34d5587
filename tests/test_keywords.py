import random
import re

import pandas as pd
from pyspark.sql import functions as F

from storyflow.functions import text as T
from storyflow.operators import keywords as K, vectors as V
from storyflow.plans import queries as Q

SIGNAL = "id long, keyword string, signal string, confidence double, ordinal int"


def hits(spark, text, lexicon=K.LEXICON, mode="suffix"):
    return spark.createDataFrame([(text,)], "x string").select(K.lexicon_hits(F.col("x"), lexicon, mode).alias("y")).first().y


def test_lexicon_quirks(spark):
    assert len(K.LEXICON) == len(set(K.LEXICON)) == 98
    assert hits(spark, "Thai food", ["ai"]) == ["ai"]            # stands before a blank
    assert hits(spark, "Thai food", ["ai"], "word") == []
    assert hits(spark, "On climate change", ["climate change"]) == []   # phrase at the very end
    assert hits(spark, "On climate change", ["climate change"], "word") == ["climate change"]
    assert hits(spark, "Climate change now", ["climate change"]) == ["climate change"]
    assert hits(spark, "the war", ["war"]) == ["war"]
    assert hits(spark, "The U.S. votes", ["u.s.", "vote"]) == []
    assert hits(spark, "end\twar\nnow", ["war"]) == ["war"]


def test_fusion_adds_signals_and_ranks(spark):
    rows = [
        (1, "Fire", "pos", None, 0), (1, "fire", "pos", None, 1),        # 2
        (1, "Rome", "ner", None, 0),                                     # 2, later signal
        (1, "cat", "pos", None, 2),                                      # 1: not above 1
        (1, "dog", "model", 0.75, 0), (1, "cow", "model", 0.8, 1),       # 1 and 1.2
        (1, "war", "manual", None, 0), (1, "war", "model", 0.4, 2),      # 1.1 - 0.4
        (2, "war", "manual", None, 0)]
    out = K.fuse_keywords(spark.createDataFrame(rows, SIGNAL))
    got = [(r.id, r.keyword, round(r.score, 6)) for r in out.orderBy("id", "rank").collect()]
    assert got == [(1, "fire", 2.0), (1, "rome", 2.0), (1, "cow", 1.2), (2, "war", 1.1)]
    lists = {r.id: r.keywords for r in K.keyword_lists(out).collect()}
    assert lists == {1: ["fire", "rome", "cow"], 2: ["war"]}


def test_annotation_filters(spark):
    toks = spark.createDataFrame([(1, "NOUN", "a", False), (1, "VERB", "b", False), (1, "PROPN", "c", True)],
                                 "id int, pos string, lemma string, is_stop boolean")
    assert [r.lemma for r in K.keep_pos(toks).collect()] == ["a"]
    ents = spark.createDataFrame([(1, "Rome", "GPE"), (1, "May", "DATE")], "id int, text string, label string")
    assert [r.keyword for r in K.keep_entities(ents).collect()] == ["rome"]


def test_model_hook_loads_once_per_task(spark):
    def load():
        return lambda s: s.str.len().map(lambda n: [float(n)])

    out = K.embed(spark.createDataFrame([("ab",), ("abc",)], "text string"), load).collect()
    assert sorted(r.embedding[0] for r in out) == [2.0, 3.0]
    assert isinstance(pd.Series([1]), pd.Series)


def test_lexicon_table(spark):
    texts = spark.createDataFrame([(1, "War and peace"), (2, "nothing")], "id int, text string")
    lex = spark.createDataFrame([("war",), ("war",), ("peace",)], "keyword string")
    assert sorted(r.keyword for r in K.lexicon_join(texts, lex).collect()) == ["peace", "war"]


def test_a_lexicon_table_finds_what_literals_find(spark):
    lines = ["supreme court rules on ai today", "thai food", "the ai", "war of words", "court", "", None, "a supreme\ncourt case", "peace treaty ai"]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    words = ["supreme court", "ai", "court", "war", "of words", "ai food", "peace treaty", "e court", "food"]
    lexicon = spark.createDataFrame([(w,) for w in words] + [(f"entry {n} x",) for n in range(6000)], "keyword string")
    for mode in ("word", "suffix"):
        want = {(r.id, r.keyword) for r in K.lexicon_match(texts, words, mode).collect()}
        assert {(r.id, r.keyword) for r in K.lexicon_join(texts, lexicon, mode=mode).collect()} == want and want


def test_weights_are_the_same_however_few_terms_are_copied(spark, monkeypatch):
    texts = [(1, "red green green blue"), (2, "red red violet"), (3, "amber"), (4, "the of"), (5, "red blue teal")]
    docs = spark.createDataFrame(texts, "id long, text string")

    def weights(hot):
        monkeypatch.setattr(V, "HOT", hot)
        return {(r.id, x.term, x.df, round(x.w, 12)) for r in V.tfidf(docs, "id").collect() for x in r.vec}

    want = weights(100)
    assert {i for i, *_ in want} == {1, 2, 3, 5} and len(want) == 9
    assert weights(1) == want and weights(3) == want


def test_steps_by_text_shuffle_whole_texts_only(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"Big Fox {n} saw the war zone", "x", "en", 9) for n in range(20)], "doc_id long, text string, source string, lang string, n_chars long")
    docs.repartition(10).write.parquet(f"{tmp_path}/documents.parquet")  # as many files as make `spread` leave them where they are
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, key in {"keyword_ranking": "id", "keyword_fusion": "id", "tfidf_weights": "id", "pos_filter": "id", "sections_until_word": "menu",
                          "sections_until_repeat": "menu", "last_wins_section": "menu"}.items():
            plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
            assert name != "sections_until_word" or " Sort [menu#" not in plan, plan
            assert moved and all(re.fullmatch(rf"{key}#\d+L?, \d+", keys) for keys in moved), (name, moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_tasks_of_placed_texts_do_not_grow(spark, monkeypatch):
    from storyflow import runtime

    rows = spark.range(1000).withColumn("text", F.lit("a"))
    monkeypatch.setattr(runtime, "TOGETHER", 50)
    assert runtime.together(rows, "id").rdd.getNumPartitions() == 20
    assert runtime.together(rows.union(rows), "id").groupBy("id").count().where("count <> 2").isEmpty()


def test_lexicon_hits_equal_a_search_per_entry_and_read_the_text_once(spark):
    """Before, each entry was looked for twice in the whole text."""
    rng = random.Random(4)
    words = ["x", "netflix", "fl", "world cup", "world", "cup final", "a b", "a", "b", "u.s.", "it's", "ñu", "😀", "(z", "d\te", "e"]
    parts = [*words, " ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x85", "-", ".", "X", "cup", "final", "d", "É", "日"]
    rows = [(n, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for n in range(1500)] + [(1500, None), (1501, ""), (1502, "netflix\nx")]
    texts = spark.createDataFrame(rows, "id int, text string").withColumn("key", T.headline_key(F.col("text"))).cache()
    for mode in ("suffix", "word"):
        got = {r.id: r.hits for r in texts.select("id", K.lexicon_hits(F.col("text"), words, mode).alias("hits")).collect()}
        for r in texts.collect():
            key = r.key or ""
            flat = " " + re.sub(r"[\t\n\x0b\f\r]", " ", key) + " "
            split = f" {' '.join(w for w in re.split(r'[ \t\n\x0b\f\r]+', key) if w)} "
            want = [k for k in words if (f" {k} " in split if mode == "word" else k + " " in key or " " not in k and f" {k} " in flat)]
            assert got[r.id] == (want if r.key is not None else []), (mode, r)
        plan = texts.select(K.lexicon_hits(F.col("text"), words, mode))._jdf.queryExecution().analyzed().toString()
        assert "Contains(" not in plan and " contains(" not in plan.lower().replace("array_contains(", ""), plan
    texts.unpersist()


def test_long_runs_do_not_exhaust_the_stack(spark):
    """Thousands of capitalised words, or of lone hyphens, in a row: a pattern that recurses once a turn fails on some 2,000."""
    n = 20_000
    rows = spark.createDataFrame([(1, "Ab Cd " * n + "y"), (2, "a " + "- " * n + "B- -c d-e")], "id long, text string").repartition(2)
    spans = K.span_signal(rows).collect()
    assert [(r.id, len(r.keyword)) for r in spans] == [(1, 6 * n - 1)]
    assert [r.y for r in rows.where("id = 2").select(T.tokens(F.col("text")).alias("y")).collect()] == [["a", "b", "c", "d-e"]]
    found = K.fuse_keywords(K.word_signal(rows).unionByName(K.span_signal(rows)).unionByName(K.lexicon_signal(rows)))
    assert {r.keyword for r in found.where("id = 1").select("keyword").collect()} == {"ab", "cd", ("ab cd " * n).strip()}


def test_possessive_patterns_match_as_before(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ABab -!_.é") for _ in range(60)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = lambda p: p[:-1]
    got = rows.select("id", F.regexp_extract_all("text", F.lit(K.SPAN), F.lit(0)).alias("new"), F.regexp_extract_all("text", F.lit(plain(K.SPAN)), F.lit(0)).alias("old"),
                      F.regexp_replace("text", T.BETWEEN, " ").alias("a"), F.regexp_replace("text", plain(T.BETWEEN), " ").alias("b")).collect()
    assert all(r.new == r.old and r.a == r.b for r in got) and any(r.new for r in got)
