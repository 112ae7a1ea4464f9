"""Pages cut into ranges, and what depends on the order of pages in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundary_ranges(pages: DataFrame, file: str, page: str, boundary: Column, expected: Column | None = None, per: int = 1) -> DataFrame:
    """Ranges (file, range_no, start, end] of pages from each boundary to before the next.

    With expected, boundaries count only if there are as many; otherwise the file is cut into fixed_ranges.
    """
    marks = pages.filter(boundary).select(file, page)
    w = Window.partitionBy(file).orderBy(page)
    last = pages.groupBy(file).agg(F.max(page).alias("_last"), *([] if expected is None else [F.first(expected).alias("_expected")]))
    ranges = (
        marks.withColumn("range_no", F.row_number().over(w).cast("long"))
        .withColumn("_next", F.lead(page).over(w))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(file)))
        .join(last, file)
        .withColumn("start", F.col(page) - 1)
        .withColumn("end", F.coalesce(F.col("_next") - 1, F.col("_last")))
    )
    if expected is None:
        return ranges.select(file, "range_no", "start", "end")
    fits = ranges.filter("_n = _expected").select(file, "range_no", "start", "end")
    others = last.join(fits.select(file).distinct(), file, "left_anti")
    return fits.unionByName(fixed_ranges(others, file, F.col("_last"), F.col("_expected"), per))


def fixed_ranges(files: DataFrame, file: str, pages: Column, expected: Column, per: int) -> DataFrame:
    """min(expected, pages // per) ranges of per pages."""
    n = F.least(expected, F.floor(pages / per)).cast("long")
    return files.select(file, F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))).alias("range_no")).select(
        file, "range_no", ((F.col("range_no") - 1) * per).alias("start"), (F.col("range_no") * per).alias("end")
    )


def islands(pages: DataFrame, file: str, page: str, boundary: Column, into: str = "segment") -> DataFrame:
    """Number of the segment that each page is in; 0 before the first boundary."""
    w = Window.partitionBy(file).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(into, F.sum(F.coalesce(boundary, F.lit(False)).cast("int")).over(w))


def until_first_hit(pages: DataFrame, file: str, page: str, hit: Column, cap: int) -> DataFrame:
    """Pages up to the first that hits, cap at most: what an early stop would have read."""
    first = F.min(F.when(hit, F.col(page))).over(Window.partitionBy(file))
    at = F.row_number().over(Window.partitionBy(file).orderBy(page))
    return pages.withColumn("_first", first).withColumn("_at", at).filter((F.col("_at") <= cap) & (F.col("_first").isNull() | (F.col(page) <= F.col("_first")))).drop("_first", "_at")


def neighbours(pages: DataFrame, file: str, page: str, flag: Column) -> DataFrame:
    """Whether the page before or after has the flag."""
    w = Window.partitionBy(file).orderBy(page)
    near = F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))
    return pages.withColumn("neighbour", near)


def pages_in_ranges(pages: DataFrame, ranges: DataFrame, file: str, page: str, text: str) -> DataFrame:
    """Each range's text, its pages (start < page <= end) in order. The file is the equi-key, so only its ranges meet it."""
    met = pages.join(ranges, file).filter((F.col(page) > F.col("start")) & (F.col(page) <= F.col("end")))
    parts = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return met.groupBy(file, "range_no").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("range_text"), F.count(F.lit(1)).alias("n_pages"))


def pick(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_at = 1").drop("_at")
