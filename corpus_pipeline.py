"""Training-data pipeline: quality rules, line dedup, near-duplicate removal, mixing and packing, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.llm import carry, mixing, packing, quality, scratch, shingles, templates, text

#: What a stage works on; a document's other columns are carried along whatever their names.
NEEDED = ["doc_id", "source", "text"]
TEXT = ["doc_id", "text"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that over 20 texts of their host hold, at any size of the host."""
    judged = quality.rules(carry.packed(docs, NEEDED), least=20, remove=True)
    return _as_documents(judged.filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates in over 20 texts, at any size; of 50 words or more, in over one."""
    return _as_documents(templates.drop_templates(carry.packed(docs, TEXT), least=20, long_words=50, variable=True, hollow=0.5), docs, TEXT)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80 % of their five-word shingles."""
    return shingles.one_of_each(docs, k=5, p=80, q=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken, whole or the span of words that a block's edge cuts off."""
    sized = carry.packed(docs, NEEDED).withColumn("size", text.n_words(F.col("text"))).withColumn("body", F.xxhash64("text"))
    mixed = mixing.mix(sized, ties=["body"])
    whole = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    spans = F.array(*[F.when(F.col(f"{s}_to") > F.col(f"{s}_from"), text.word_span(F.col("text"), F.col(f"{s}_from"), F.col(f"{s}_to"))) for s in ("span1", "span2")])
    taken = mixed.withColumn("text", F.explode(F.concat(whole, F.filter(spans, lambda x: x.isNotNull()))))
    return _as_documents(taken, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of 2,048 words."""
    return packing.pack(docs.select("doc_id", "source", packing.same_words(F.col("text")).alias("cluster"), text.n_words(F.col("text")).alias("size")))


def _as_documents(rows: DataFrame, docs: DataFrame, needed: list[str] = NEEDED) -> DataFrame:
    """The columns of documents, n_chars as the text now has."""
    rows = carry.unpacked(rows, docs, needed, [])
    return rows.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: The Jaccard join's components and the packing cannot be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
