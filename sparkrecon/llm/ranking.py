"""Ranks over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.llm import scratch


def ranked(df: DataFrame, group: list[str], order: list[Column], into: str) -> DataFrame:
    """Number the rows from 1 within each group by order, which must be total.

    Rows are range-partitioned by group and order, numbered in each range, and shifted by the rows of earlier
    ranges (one count a range); a group's own first number is then taken off. No group meets in one task.
    """
    keys = [F.col(c).asc_nulls_last() for c in group] + order
    ranges = scratch.table(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_range").orderBy(*keys)
    numbered = (
        ranges.join(F.broadcast(shifts), "_range")  # one row a partition
        .withColumn(into, F.row_number().over(within) + F.col("_shift"))
        .drop("_range", "_shift")
    )
    if not group:
        return numbered
    first = numbered.groupBy(*group).agg((F.min(into) - 1).alias("_first"))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in group]
    on = same[0]
    for cond in same[1:]:
        on = on & cond
    return (
        numbered.alias("_l")
        .join(first.alias("_r"), on)
        .select(*[F.col(f"_l.{c}") for c in df.columns], (F.col(into) - F.col("_first")).alias(into))
    )
