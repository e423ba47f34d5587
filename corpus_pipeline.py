"""From raw documents to the token ids of a balanced, de-duplicated mix.

Each stage takes (spark, docs, sf_dir) and returns all of its documents that go on; the result is written and read again
as the next one's input. All stages but the last return the columns of ``documents``. Null texts, empty tables, repeated rows and
further columns pass as the operators' docstrings say. A stage returns its input's columns only, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from storyflow.llm import bpe, language, line_dedup, mixing, near_dup
from storyflow.llm.common import TEXTS
from storyflow.llm.queries import WORD_BPE
from storyflow.runtime import cut, dealt, scratch_path

NEAR = 80  # percent of common shingles; op8's own limit is 85


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can name; ``lang`` becomes that language.

    It learns from the labelled rows of ``docs``. Texts without a letter, null ones too, go, and texts that fit no language:
    with a calibrated score near chance, or too few n-grams known from training (limits from rows kept back, ``Model.judge``).
    If no row is labelled, nothing can be learned and only texts without a letter go.
    """
    columns = docs.columns
    model = language.fit(docs)
    found = language.identify(dealt(docs, TEXTS), model, keep=tuple(columns), lang="__lang", score="__score", fits="__fits")
    if not model.languages:
        return found.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(columns)
    return found.where("__fits").select(
        *(F.col("__lang").alias(c) if c == "lang" else F.col(c) for c in columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with later repeated runs of lines deleted from their texts; ``n_chars`` follows."""
    done = line_dedup.dedup_lines(docs)
    return done.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id; texts without words all stay.

    Near duplicates have ``NEAR`` percent of their shingles in common. If the least id is in several rows of a group, the one
    with the least text stays; without any id, likewise.
    """
    found = near_dup.near_duplicates(docs, similar=NEAR)
    none, number = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(none, number, "tie")).alias("first"))
    alone = found.where("n_shingles = 0").select(none, number, "tie").distinct()
    keys = cut(first.select("first.*", F.lit(True).alias("words")).unionByName(alone.withColumn("words", F.lit(False))))
    own = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__tie": F.xxhash64("text")})
    named = keys.select(*(F.col(c).alias(f"__{c}") for c in ("none", "id", "tie", "words")))
    again = F.row_number().over(Window.partitionBy("__none", "__id", "__tie").orderBy(F.lit(0)))
    return own.join(named, ["__none", "__id", "__tie"]).withColumn("__nth", again).where("__nth = 1 OR NOT __words").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix begins it, not at all where its source has more than its share."""
    return mixing.mixed(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of every document of the mix, the ids checked by decoding them."""
    coded = bpe.decode(bpe.encode(dealt(docs, TEXTS), WORD_BPE, keep=("doc_id", "source", "lang")), WORD_BPE)
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_ids),
]

# A trained classifier decides in the first stage, which SQL cannot express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
