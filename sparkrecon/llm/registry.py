"""The operators' queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.llm import embeddings, licenses, lm, mixing, oracle, packing, quality, quotes, repair, shingles, spelling, templates, text, tokens, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words"]
    judged = quality.rules(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return tokens.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return templates.drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return embeddings.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "source", text.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("body"))
    return mixing.mix(rows, ties=["body"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), k=3, p=90, q=100)


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return quotes.link(messages)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return packing.pack(docs.select("doc_id", "source", packing.same_words(F.col("text")).alias("cluster"), text.n_words(F.col("text")).alias("size")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return spelling.variants(spelling.damaged_words(docs))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", *[c for c in licenses.ADDED if c != "spans"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.repaired(repair.damaged(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_lm_scores": op3_lm_scores,
        "op4_line_templates": op4_line_templates,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_near_duplicates": op6_embedding_near_duplicates,
        "op7_mix_sources": op7_mix_sources,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_quotation_links": op9_quotation_links,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_license_scan": op12_license_scan,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force: hashed folds with learned weights, seeded shuffles, tokenizers."""
    return {
        "op1_quality_rules": oracle.QUALITY,
        "op4_line_templates": oracle.TEMPLATES,
        "op6_embedding_near_duplicates": oracle.EMBEDDINGS,
        "op8_jaccard_join": oracle.JACCARD,
        "op11_spelling_variants": oracle.SPELLING,
        "op13_conversation_repair": oracle.REPAIR,
    }
