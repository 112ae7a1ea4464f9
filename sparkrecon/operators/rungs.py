"""Extraction ladders: cheap readings first, costly ones only for what is still open."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import text as T
from sparkrecon.operators.store import written

# What a result says it was read by, regions in the order they are tried, and what is said of none.
LAYER, REGION, FULL = "pdfplumber", "region_ocr", "full_page_ocr"
COMPANY_REGIONS = ("middle", "top", "bottom")
NO_NOTICE, NO_COMPANY = "未找到责令号", "未找到公司名称"
TITLE = "强制执行申请书"


@dataclass(frozen=True)
class Rung:
    """One reading of a page: text, a Column that may be a costly function (or a struct of text and error), on the rows
    where; value is what the text must hold (null for nothing), of a right form by valid. ends: an error settles the unit."""

    method: str
    text: Column
    value: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    where: Column | None = None
    region: str | None = None
    fallback: bool = False
    ends: bool = False


def ladder(pages: DataFrame, key: Sequence[str], page: str, rungs: Sequence[Rung], none: str) -> DataFrame:
    """A row a unit (key, of pages): success, value, method, page, region, fallback, error, by the first rung with a value on its least page.

    A rung's text is worked out for the pages of units that no earlier rung has settled, and is written before anything
    looks at it: so a costly reading runs once a row, and not again when an executor is lost. Units without a value have
    the last rung's method and fallback; an error of that rung, else none, as error. Units of null keys are left out.
    """
    key = list(key)
    rest = written(pages.dropna(subset=key))
    found = None
    for rung in rungs:
        rows = rest if rung.where is None else rest.filter(rung.where)
        read = rows.select(*key, F.col(page).alias("_page"), rung.text.alias("_read"))
        split = dict(read.dtypes)["_read"].startswith("struct")
        read = written(read.select(*key, "_page", F.col("_read.text" if split else "_read").alias("_text"), (F.col("_read.error") if split else F.lit(None)).cast("string").alias("_error")))
        value = rung.value(F.col("_text"))
        if rung.valid is not None:
            value = F.when(rung.valid(value), value)
        hit = F.when(F.col("_error").isNull(), value)
        stop = F.col("_error").isNotNull() if rung.ends else F.lit(False)
        at = read.select(*key, F.struct("_page", hit.alias("value"), "_error").alias("h")).filter(F.col("h.value").isNotNull() | (stop & F.col("h._error").isNotNull()))
        settled = written(at.groupBy(*key).agg(F.min("h").alias("h")).select(
            *key, F.col("h.value").isNotNull().alias("success"), F.col("h.value").alias("value"), F.lit(rung.method).alias("method"), F.when(F.col("h.value").isNotNull(), F.col("h._page")).alias("page"),
            F.lit(rung.region).cast("string").alias("region"), F.lit(rung.fallback).alias("fallback"), F.when(F.col("h.value").isNull(), F.col("h._error")).alias("error"),
        ))
        found = settled if found is None else found.unionByName(settled)
        rest = rest.join(settled.select(*key), key, "left_anti")
        if rest.isEmpty():
            return found
    last = rungs[-1]
    open_ = rest.select(*key).distinct().select(
        *key, F.lit(False).alias("success"), F.lit(None).cast("string").alias("value"), F.lit(last.method).alias("method"), F.lit(None).cast(dict(pages.dtypes)[page]).alias("page"),
        F.lit(None).cast("string").alias("region"), F.lit(last.fallback).alias("fallback"), F.lit(none).alias("error"),
    )
    return found.unionByName(open_)


def _notice(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, T.NOTICE, 0), F.lit(""))


def notice_ladder(pages: DataFrame, file: str, page: str, layer: Column, header: Column, full: Column, max_pages: int = 3) -> DataFrame:
    """Each file's identifier: out of the text layer of its first max_pages pages, else the header of each page in turn, else whole pages in turn.

    A page is read only if no page before it had an identifier of a right form. An error ends the whole-page rung.
    """
    turn = range(1, max_pages + 1)
    at = lambda p: F.col(page) == p
    rungs = [
        Rung(LAYER, layer, _notice, D.valid_notice, F.col(page) <= max_pages),
        *[Rung(REGION, header, _notice, D.valid_notice, at(p), "notice_header") for p in turn],
        *[Rung(FULL, full, _notice, D.valid_notice, at(p), fallback=True, ends=True) for p in turn],
    ]
    return ladder(pages, [file], page, rungs, NO_NOTICE)


def application_ladder(pages: DataFrame, file: str, page: str, title: Column, full: Column, pages_per_case: int = 2) -> DataFrame:
    """A row a file: start_pages (in order), method, pages_checked and fallback_count.

    A page begins an application by the title in its upper region; where that has none, a first page of a case is read whole.
    """
    begins = lambda c: F.when(F.contains(c, F.lit(TITLE)), TITLE)
    titled = lambda c: F.when(D.valid_title(c), TITLE)
    rungs = [Rung(REGION, title, titled), Rung(FULL, full, begins, where=F.col("_at") % pages_per_case == 1, fallback=True)]
    each = _by_page(pages, file, page, rungs, "").select(file, "success", "fallback", F.col(page).alias("_start"))
    began, fallen = F.col("success"), F.count_if(F.col("success") & F.col("fallback"))
    return each.groupBy(file).agg(
        F.sort_array(F.collect_list(F.when(began, F.col("_start")))).alias("start_pages"),
        F.when(fallen > 0, FULL).when(F.count_if(began) > 0, REGION).alias("method"), F.count(F.lit(1)).alias("pages_checked"), fallen.alias("fallback_count"),
    )


def company_ladder(pages: DataFrame, file: str, page: str, regions: dict[str, Column], full: Column) -> DataFrame:
    """Each page's company: out of its regions in their order, of a right form; else the first in the whole page, of any form."""
    rungs = [Rung(REGION, regions[r], D.first_company, D.valid_company, region=r) for r in COMPANY_REGIONS if r in regions]
    return _by_page(pages, file, page, [*rungs, Rung(FULL, full, D.first_company, fallback=True)], NO_COMPANY)


def _by_page(pages: DataFrame, file: str, page: str, rungs: Sequence[Rung], none: str) -> DataFrame:
    """The ladder with a page as its unit."""
    out = ladder(pages.withColumn("_at", F.col(page)).withColumnRenamed(page, "_unit"), [file, "_unit"], "_at", rungs, none)
    return out.drop("page").withColumnRenamed("_unit", page)
