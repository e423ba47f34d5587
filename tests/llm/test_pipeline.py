"""The pipeline stage by stage and as a whole, against brute force; the registration."""

import random

import pytest
from pyspark.sql import functions as F
from test_text import brute_groups, brute_lines, brute_sets, speech
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from storyflow.llm import near_dup
from storyflow.llm.queries import WORD_BPE
from storyflow.runtime import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus():
    rng = random.Random(4)
    passage = "\n".join(speech("xa", 9, 1000 + k) + f" p{k}" for k in range(5))
    rows = []
    for k in range(60):
        lang = "xa" if k % 3 else "yb"
        text = "\n".join(speech(lang, rng.randint(5, 14), 50 * k + n) + f" {k} {n}" for n in range(6))
        rows.append((k, text if k % 7 else text + "\n" + passage, lang, "ab"[k % 2] if k % 5 else None))
    rows += [(100 + k, rows[8][1].replace("0", "zero", 1), "xa", "hot") for k in range(3)] + [(200, rows[9][1], None, "a")]
    return rows + [(300, None, "xa", "a"), (301, "", "xa", "a"), (302, "12 34 !!", None, "b"), (None, speech("yb", 30, 9), None, "b"), (303, speech("xa", 4000, 5), "xa", "c")]


def test_stages_take_effect(spark, documents, corpus):
    docs = documents(corpus)
    kept = pipeline.identify_language(spark, docs, "")
    rows = sorted(map(tuple, kept.collect()), key=str)
    assert kept.columns == COLUMNS and len(rows) == len(corpus) - 3
    words = set(speech("yb", 200, 1).split())
    assert all(r[2] == ("yb" if r[1].split()[0] in words else "xa") for r in rows)

    fewer = pipeline.dedup_lines(spark, spark.createDataFrame(rows, docs.schema), "")
    lines = sorted(map(tuple, fewer.collect()), key=str)
    assert fewer.columns == COLUMNS and all(r[4] == len(r[1]) for r in lines)
    assert sorted((str(r[0]), r[1]) for r in lines) == sorted((i, t) for i, _, _, t in brute_lines([(r[0], r[1]) for r in rows]))

    once = pipeline.drop_near_duplicates(spark, spark.createDataFrame(lines, docs.schema), "")
    left = sorted(map(tuple, once.collect()), key=str)
    groups = brute_groups([(r[0], r[1]) for r in lines])
    assert once.columns == COLUMNS
    assert sorted(str(r[0]) for r in left if r[0] is not None) == sorted(i for i, _, _, k in groups if k)
    assert sum(r[0] is None for r in left) == 1

    mix = pipeline.mix_sources(spark, spark.createDataFrame(left, docs.schema), "")
    taken = mix.collect()
    assert mix.columns == COLUMNS and {tuple(r) for r in taken} <= set(left)
    times = mix.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    size = lambda rows: sum(len(r[1].split()) for r in rows)
    assert times <= 3 and abs(size(taken) - size(left)) <= 4 * max(len(r[1].split()) for r in left)

    out = pipeline.encode_ids(spark, mix, "").collect()
    lib = Tokenizer.from_file(WORD_BPE)
    texts = {r[0]: r[1] for r in left}
    assert len(out) == len(taken) and all(list(r.ids) == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out)


def test_near_stage_keeps_one_of_repeated_rows_and_groups_without_ids(spark, documents):
    same = "one two three four five six seven"
    docs = documents([(1, same), (1, same), (None, "a b c d e f g"), (None, "A b c d e f g"), (2, ""), (2, ""), (3, None)])
    left = sorted((str(r.doc_id), (r.text or "").lower()) for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left == [("1", same), ("2", ""), ("2", ""), ("3", ""), ("None", "a b c d e f g")]


def test_run_writes_and_rereads_each_stage(spark, documents, corpus):
    folder = scratch_path(spark, "corpus")
    documents(corpus).write.parquet(f"{folder}/documents.parquet")
    got = entry.queries()["pipeline"](spark, folder)
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"]
    again = pipeline.run(spark, folder)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, again.collect()))
    empty = scratch_path(spark, "corpus")
    documents(corpus).limit(0).write.parquet(f"{empty}/documents.parquet")
    assert pipeline.run(spark, empty).count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert {n.split("_")[0] for n in entry.oracle_sql() if n.startswith("op")} == {"op3", "op5", "op7", "op8", "op9", "op12", "op13"}
    assert [name for name, _ in pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "bpe"]


def altered(words, n):
    """``words`` with ``n`` of them changed, all far apart."""
    w = list(words)
    for k in range(n):
        w[10 + 40 * k] = f"changed{k}"
    return " ".join(w)


def test_near_stage_links_from_eighty_percent(spark, documents):
    rows, want = [], []
    for g in range(12):
        words = [f"w{g}x{random.Random(9 * g).randrange(10**6)}n{k}" for k in range(300)]
        for n in (0, 5 + g % 3):  # 84.4, 81.6 or 78.8 percent of common shingles
            rows.append((len(rows), altered(words, n)))
        a, b = brute_sets(rows[-2][1]), brute_sets(rows[-1][1])
        assert 78 < 100 * len(a & b) / len(a | b) < 85
        want += [rows[-2][0]] + [rows[-1][0]] * (100 * len(a & b) < 80 * len(a | b))
    docs = documents(rows).repartition(3)
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == want and len(want) == 16
    assert all(r.kept for r in near_dup.near_duplicates(docs).collect())  # op8 has its own limit
    assert sorted(r.doc_id for r in near_dup.near_duplicates(docs, similar=80).where("kept").collect()) == want


def test_bands_and_margin_follow_the_limit():
    assert near_dup.bands_for(near_dup.SIMILAR) == near_dup.BANDS and near_dup.margin_for(near_dup.SIMILAR) == near_dup.MARGIN
    for similar in (80, 85, 90):
        assert (1 - (similar / 100) ** near_dup.ROWS) ** near_dup.bands_for(similar) < near_dup.MISSED
    assert near_dup.margin_for(80) > near_dup.MARGIN
    with pytest.raises(ValueError):
        near_dup.bands_for(50)


def test_the_language_stage_rejects_other_scripts(spark, documents, corpus):
    odd = [(400, "これは日本語の文章です。今日は天気がいい" * 4, None, "b"), (401, "Сегодня хорошая погода и мы пошли гулять " * 4, None, "b")]
    kept = {r.doc_id for r in pipeline.identify_language(spark, documents(corpus + odd), "").collect()}
    assert kept == {r[0] for r in corpus} - {300, 301, 302}


def test_the_python_steps_read_few_texts_at_once(spark, tmp_path):
    """A file was one batch of up to ten thousand whole texts, on both sides of the pipe."""
    n = 2_000 * (spark.sparkContext.defaultParallelism + 1)
    spark.range(n).coalesce(1).selectExpr(
        "id AS doc_id", "concat('word ', id) AS text", "CAST(null AS string) AS lang", "'s' AS source", "9L AS n_chars").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for done in (pipeline.identify_language(spark, docs, ""), near_dup.described(docs, ["doc_id"], "text"), pipeline.encode_ids(spark, docs, "")):
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2_000
