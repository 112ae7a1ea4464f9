"""Small pieces that no query reaches: sheets, cells, keys, hits, queue."""

from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import rules
from sparkrecon.operators import metrics, outputs
from sparkrecon.sources import ledger
from sparkrecon.streaming import queue


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_header_and_width(spark):
    table = spark.range(1).select(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(28)])
    got = ledger.header(table)
    assert [got[i] for i in (0, 25, 26, 27)] == [("A", "c0"), ("Z", "c25"), ("AA", "c26"), ("AB", "c27")]
    assert ledger.wide_enough(table, 28).count() == 1  # empty cells count as columns
    assert ledger.wide_enough(table, 29).count() == 0


def test_column_values(spark):
    rows = spark.createDataFrame([(3, " c "), (1, "a"), (2, None), (4, " "), (5, "e"), (6, "f")], "n int, v string")
    assert sorted((r.row, r.value) for r in ledger.column_values(rows, "v", 2, 5, F.col("n")).collect()) == [(3, "c"), (5, "e")]
    assert ledger.column_values(rows.limit(0), "v", 1, 5, F.col("n")).count() == 0


def test_with_fallback(spark):
    rows = spark.createDataFrame([(1, "x" * 100, "o"), (2, " " * 200, "o"), (3, "short", None), (4, None, None)], "i int, layer string, other string")
    got = ledger.with_fallback(rows, F.col("layer"), F.col("other")).orderBy("i").collect()
    assert [r.text for r in got] == ["x" * 100, "o", "short", None]


def test_keys(spark):
    assert values(spark, ledger.result_key, ["a.PDF", "b_ultra_result", "c_ultra_result.pdf", "d.txt", None]) == ["a", "b", "c", "d.txt", None]
    assert values(spark, D.court_key, [" (2025)粤 71[1]号 ", "", None]) == ["（2025）粤71（1）号", "", None]
    assert values(spark, D.normal_date, [" 二○二零年 ", None]) == ["二〇二〇年", None]
    assert values(spark, D.task_number, ["a-b-12", "x", "7-y", None]) == ["12", "x", "7-y", None]


def test_all_hits(spark):
    wanted = [rules.Rule("long", r"(\d{4})", 1.0, 1), rules.Rule("any", r"(\d+)", 0.5, 1)]
    hits = values(spark, lambda c: D.all_hits(c, wanted), ["7 and 2024 and 9", "none", None])
    assert sorted((h.source, h.value) for h in hits[0]) == [("any", "2024"), ("any", "7"), ("any", "9"), ("long", "2024")]
    assert [h.confidence for h in hits[0]] == sorted((h.confidence for h in hits[0]), reverse=True)
    assert not hits[1]


def test_enrichment_sheet(spark):
    names = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "row_no int, original_name string")
    results = spark.createDataFrame([("a", "1234", None, "success")], "original_name string, code string, city string, status string")
    got = [tuple(r) for r in outputs.enrichment_sheet(names, results, ["code", "city"]).select("row_no", "code", "city", "status").collect()]
    assert got == [(1, "1234", "", "success"), (2, "", "", "pending"), (3, "1234", "", "success")]


def test_slim_report(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["x"]), ([], None)], "ids array<string>, words array<string>")
    assert [tuple(r) for r in metrics.slim_report(rows, "ids", "words").collect()] == [("a、b", "x"), ("", None)]


def test_tasks_are_in_the_order_given(spark):
    rows = spark.createDataFrame([("n", "b.pdf", 2), ("n", "a.pdf", 3), ("m", "a.pdf", 1)], "doc_type string, file string, at int")
    got = queue.tasks(rows, [F.col("at")], 5).orderBy("created").collect()
    assert [(r.task, r.created, r.attempts, r.state) for r in got] == [("m|a.pdf", 5, 0, "pending"), ("n|b.pdf", 6, 0, "pending"), ("n|a.pdf", 7, 0, "pending")]


def test_updated_ledger_takes_the_last_ruling_by_its_order(spark):
    sheet = spark.createDataFrame([(1, "old"), (2, "kept")], "row_no long, court_number string")
    found = spark.createDataFrame([("k9", 9, "nine"), ("k10", 10, "ten")], "key string, at int, court_number string").select("*", *[F.lit("").alias(c) for c in ("judge", "clerk", "ruling_date")])
    links = spark.createDataFrame([("k9", 1), ("k10", 1)], "key string, row_no long")
    got = outputs.updated_ledger(sheet, found, links, "at").orderBy("row_no").collect()
    assert [(r.row_no, r.court_number) for r in got] == [(1, "ten"), (2, "kept")]
