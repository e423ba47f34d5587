"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import scratch_path, table
from . import bpe, filter_audit, fingerprints, language, lexical, line_dedup, mixing, near_dup, page_text, pii, token_counts, token_file, topk

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def predicted_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.integers("embedding").alias("v"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-file")
    token_file.write_tokens(table(spark, sf_dir, "documents"), folder, BYTE_BPE)
    return token_file.documents(token_file.read_tokens(spark, folder))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def fewer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("tie", "component")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *(F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def audited_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe_round_trip": bpe_round_trip,
    "op2_language": predicted_language,
    "op3_top_k": nearest_vectors,
    "op4_token_file": token_ids,
    "op5_mixing": mixed_sources,
    "op6_token_counts": count_tokens,
    "op7_line_dedup": fewer_lines,
    "op8_near_duplicates": near_duplicates,
    "op9_page_text": main_texts,
    "op10_fingerprints": document_fingerprints,
    "op11_pii": personal_data,
    "op12_filter_audit": audited_filters,
    "op13_lexical_search": ranked_documents,
}
