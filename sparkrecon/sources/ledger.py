"""Positional ledgers and files of pages as tables. Every path is read by Spark, so any store it knows will do."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrecon.functions import text as T
from sparkrecon.operators.outputs import numbered


def positional(table: DataFrame, places: Mapping[str, int], order: Column | None = None) -> DataFrame:
    """Cells by position as stripped strings ('' for none), with order as row_no.

    Give the sheet's own row number as order; without it, row_no only tells rows of one read apart.
    """
    columns = table.columns
    cells = table.select(
        *[(T.safe_cell(F.col(f"`{columns[i]}`")) if i < len(columns) else F.lit("")).alias(name) for name, i in places.items()],
        (F.monotonically_increasing_id() if order is None else order).alias("row_no"),
    )
    return cells


def cases(table: DataFrame, original: int = 1, renamed: int = 2, company: int = 4) -> DataFrame:
    """The ledger of notices: rows whose original name is a notice's, with sequence, notice_number and company_name."""
    rows = positional(table, {"original": original, "renamed": renamed, "company_name": company})
    rows = rows.filter(F.contains("original", F.lit("责字")) & F.contains("renamed", F.lit("责催-")) & (F.col("company_name") != ""))
    return rows.select("row_no", F.replace(F.split("renamed", "-责催-")[0], F.lit(" "), F.lit("")).alias("sequence"), F.replace("original", F.lit(" "), F.lit("")).alias("notice_number"), "company_name")


def enforcement_cases(table: DataFrame, places: Mapping[str, int], keyword: str = "责字") -> DataFrame:
    """The ledger of rulings: rows whose notice has the keyword; the amount as a number, null where it is none."""
    rows = positional(table, places).filter(F.contains("notice_number", F.lit(keyword)))
    return rows.withColumn("amount", T.amount(F.col("amount"))) if "amount" in places else rows


def header(table: DataFrame) -> list[tuple[str, str]]:
    """Column letters and names of a sheet."""

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    return [(letters(i), c) for i, c in enumerate(table.columns)]


def column_values(table: DataFrame, column: str, first: int, last: int, order: Column) -> DataFrame:
    """Values of rows first to last (from 1) that are not blank, with their row numbers."""
    rows = numbered(table.select(T.safe_cell(F.col(column)).alias("value"), order.alias("_order")), [F.col("_order")], "row").select("value", "row")
    return rows.filter(F.col("row").between(first, last) & (F.col("value") != ""))


def files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """Files with their content, name, stem and a key that changes with them; of equal names the first path stays."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.endswith(F.lower("name"), F.lit(suffix.lower())))
    df = df.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    df = df.withColumn("cache_key", F.concat_ws("|", "stem", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")))
    return df.withColumn("_at", F.row_number().over(Window.partitionBy("name").orderBy("path"))).filter("_at = 1").drop("_at")


def text_pages(spark: SparkSession, path: str, mark: str = "\f") -> DataFrame:
    """Text files as pages (file, page, text), cut at form feeds; pages without text are left out."""
    whole = files(spark, path).select(F.col("name").alias("file"), F.split(F.decode("content", "utf-8"), mark).alias("pages"))
    return whole.select("file", F.posexplode("pages").alias("page", "text")).select("file", (F.col("page") + 1).alias("page"), T.strip(F.col("text")).alias("text")).filter("text <> ''")


def pending(found: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """What the cache does not have yet."""
    return found.join(cache.select(key), key, "left_anti")


def wide_enough(table: DataFrame, least: int) -> DataFrame:
    """All rows of a sheet of at least so many columns, none of a narrower one: empty cells count as columns."""
    return table if len(table.columns) >= least else table.limit(0)


def names_between(table: DataFrame, column: str, order: Column, first: int = 1, last: int | None = None) -> DataFrame:
    """Values of a named column that are not null, from the first to the last of them (from 1)."""
    rows = numbered(table.filter(F.col(column).isNotNull()).select(F.trim(F.col(column).cast("string")).alias("name"), order.alias("_order")), [F.col("_order")], "row_no")
    rows = rows.select("row_no", "name").filter(F.col("row_no") >= first)
    return rows if last is None else rows.filter(F.col("row_no") <= last)


def page_counts(pages: DataFrame, file: str) -> DataFrame:
    return pages.groupBy(file).agg(F.count(F.lit(1)).alias("pages"))


def with_fallback(layers: DataFrame, text: Column, other: Column, least: int = 100) -> DataFrame:
    """Add text: the text layer, or where that has under least characters the other reading, if there is one."""
    return layers.withColumn("text", F.when(F.length(T.strip(F.coalesce(text, F.lit("")))) >= least, text).otherwise(F.coalesce(other, text)))


def result_key(file: Column) -> Column:
    """The name under which a file's result is found: without .pdf and without _ultra_result."""
    return F.regexp_replace(F.regexp_replace(file, r"(?i)\.pdf$", ""), "_ultra_result$", "")


def whole_text(pages: DataFrame, file: str, page: str, text: str) -> DataFrame:
    """A file's pages in order under headings, in one row."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(file).agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("=== 第"), x["p"].cast("string"), F.lit("页 ===\n"), x["t"])), "\n\n").alias("full_text"))
