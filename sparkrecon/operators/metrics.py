"""Measures of what was read: pages, keywords, boundaries, input material, merged results and whole runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(n: Column, of: Column, digits: int = 2) -> Column:
    """n of of in percent, 0 of none."""
    return F.coalesce(F.round(F.try_divide(n * 100.0, of), digits), F.lit(0.0))


def document_summary(pages: DataFrame, file: str, page: str) -> DataFrame:
    """A row a file: pages, seconds, pages read as a whole and their share, region attempts and seconds, the slowest page (the first of two).

    pages: duration, fallback (boolean), attempts, region_seconds.
    """
    return pages.groupBy(file).agg(
        F.count(F.lit(1)).alias("page_count"), F.round(F.sum("duration"), 4).alias("total_duration"), F.count_if("fallback").alias("fallback_pages"),
        F.round(F.avg(F.col("fallback").cast("int")), 4).alias("fallback_rate"), F.sum("attempts").alias("region_attempts"), F.round(F.sum("region_seconds"), 4).alias("region_seconds"),
        F.max_by(page, F.struct(F.col("duration"), -F.col(page))).alias("slowest_page"),
    )


def page_metrics(pages: DataFrame, file: str, flags: Sequence[str]) -> DataFrame:
    """A row a file: pages, mean seconds, and for each flag the share of pages in percent."""
    return pages.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg("duration").alias("seconds_per_page"), *[_rate(F.count_if(f), F.count(F.lit(1))).alias(f"{f}_rate") for f in flags]
    )


def keyword_metrics(texts: DataFrame, file: str, text: str, words: Sequence[str], marker: str, expected: Column, boundaries: Column) -> DataFrame:
    """A row a file: keywords found in percent, how often the marker stands in the text, how near that is to what is expected.

    Up to half as many again as expected count in proportion, 100 at most; more give 50.
    """
    found = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    times = F.regexp_count(F.col(text), F.lit(marker))
    near = F.when(expected <= 0, 0.0).when(times <= expected * 1.5, F.least(times / expected * 100, F.lit(100.0))).otherwise(50.0)
    return texts.select(
        file, (found * 100.0 / len(words)).alias("keyword_rate"), times.alias("detected"), near.alias("detection_accuracy"),
        F.when(expected > 0, F.least(boundaries / expected * 100, F.lit(100.0))).otherwise(0.0).alias("boundary_rate"),
        F.when(times == 0, "FAIL").otherwise("PASS").alias("status"),
    )


def company_metrics(pages: DataFrame, file: str, text: str, words: Sequence[str], expected: Column, per: int = 1) -> DataFrame:
    """A row a file: shares of pages read as a whole, usable by region and with the marker, and whether there are as many pages as expected.

    A keyword is found if any page holds it; without one the status is WARNING.
    """
    has = F.max(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))) > 0
    n = F.count(F.lit(1))
    rows = pages.groupBy(file).agg(
        n.alias("n_pages"), _rate(F.count_if("fallback"), n).alias("fallback_rate"), _rate(F.count_if("usable"), n).alias("usable_rate"), _rate(F.count_if("marked"), n).alias("marker_rate"),
        has.alias("keyword_found"), F.first(expected).alias("_expected"),
    )
    return rows.withColumn("page_count_match", F.col("n_pages") == F.col("_expected") * per).withColumn("status", F.when(F.col("keyword_found"), "PASS").otherwise("WARNING")).drop("_expected")


def input_check(files: DataFrame, expected: Column, pages_per_case: DataFrame) -> DataFrame:
    """A row a kind of document (doc_type, file, pages): files, pages, cases that these make, and OK, WARN or missing.

    pages_per_case: doc_type, per; kinds that it lacks have one page a case.
    """
    kinds = files.groupBy("doc_type").agg(F.count("file").alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    kinds = kinds.join(pages_per_case.select(F.col("doc_type").alias("_kind"), F.col("per").alias("_per")), F.col("doc_type") == F.col("_kind"), "left")
    kinds = kinds.withColumn("cases", F.floor(F.col("pages") / F.coalesce("_per", F.lit(1)))).drop("_kind", "_per")
    return kinds.withColumn("status", F.when(F.col("files") == 0, "missing").when(F.col("cases") == expected, "OK").otherwise("WARN"))


def merged_results(tasks: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """Finished tasks of a file as one result: pages in order, seconds summed, texts joined by line breaks. A file's pages stand in one row."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_text"))))
    return tasks.groupBy(file).agg(F.array_join(F.transform(parts, lambda x: x["_text"]), "\n").alias("full_text"), F.count(F.lit(1)).alias("n_pages"), F.sum("duration").alias("total_duration"))


def best_candidate(rows: DataFrame, group: str, kinds: Sequence[str], name: str) -> DataFrame:
    """Each group's candidate of the best kind, then score, then the longest name, then the first."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    w = Window.partitionBy(group).orderBy(rank, F.col("score").desc(), F.length(name).desc(), name)
    return rows.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def run_rollup(batches: DataFrame, batch: str, counters: Sequence[str], passed: str, total: str) -> DataFrame:
    """Sums of a run's counters by batch and over all (null batch), the rate worked out anew from the sums."""
    sums = batches.rollup(batch).agg(*[F.sum(c).alias(c) for c in counters])
    return sums.withColumn("pass_rate", F.coalesce(F.round(F.try_divide(F.col(passed), F.col(total)), 4), F.lit(0.0)))


def newest(rows: DataFrame, group: str, finished: str, keep: int = 5) -> DataFrame:
    """The newest finished rows of each group."""
    w = Window.partitionBy(group).orderBy(F.col(finished).desc())
    return rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= keep).drop("_at")


def slim_report(rows: DataFrame, ids: str, words: str, most_ids: int = 2, most_words: int = 3) -> DataFrame:
    """Report rows with the first few identifiers and keywords as text."""
    return rows.withColumn(ids, F.array_join(F.slice(ids, 1, most_ids), "、")).withColumn(words, F.array_join(F.slice(words, 1, most_words), "、"))
