"""Validation statuses and quality, timing and matching reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def notice_status(pages: Column, found: Column, expected: Column, remapped: Column, ratio: Column) -> Column:
    """struct<status, category> of a document by what was read and what the ledger expects."""
    of = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("category"))
    return (
        F.when((pages == 0) | ~found, of("FAIL", "ocr_failure"))
        .when(remapped, of("WARNING", "basis_mismatch"))
        .when(expected, of("PASS", ""))
        .when(ratio >= 0.85, of("WARNING", "fuzzy_mapping"))
        .otherwise(of("FAIL", "heuristic_mismatch"))
    )


def status_summary(rows: DataFrame, status: str) -> DataFrame:
    """One row: total, how many of each status, and the share that passed (0 of none)."""
    n = lambda s: F.count_if(F.col(status) == s)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), n("PASS").alias("passed"), n("WARNING").alias("warnings"), n("FAIL").alias("failed"),
        F.coalesce(F.try_divide(n("PASS"), F.count(F.lit(1))), F.lit(0.0)).alias("pass_rate"),
    )


def timing(rows: DataFrame, kind: str, duration: str) -> DataFrame:
    """Count, sum, least, most and mean of the positive durations of each kind."""
    d = F.col(duration)
    return rows.filter(d > 0).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("total"), F.min(d).alias("least"), F.max(d).alias("most"), F.avg(d).alias("mean"))


def match_stats(pairs: DataFrame, probe: str, row: str) -> DataFrame:
    """Different probes and rows, how many of either are matched, and the rates in percent."""
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a * 100.0, b), 1), F.lit(0.0))
    n, m = F.countDistinct(probe), F.countDistinct(F.when(F.col(row).isNotNull(), F.col(probe)))
    return pairs.agg(n.alias("probes"), m.alias("matched"), F.countDistinct(row).alias("rows_matched"), rate(m, n).alias("match_rate"))


def slowest(rows: DataFrame, group: str, page: str, duration: str) -> DataFrame:
    """Pages, seconds, and the slowest page (the first of two) of each document."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(duration).alias("seconds"), F.max_by(page, F.struct(F.col(duration), -F.col(page))).alias("slowest"))


def quality_bucket(n: Column, good: int, fair: int) -> Column:
    return F.when(n >= good, "good").when(n >= fair, "fair").otherwise("poor")
