from pyspark.sql import functions as F

from sparkrecon.functions import text as T
from sparkrecon.operators import matching, reports, segments, tables
from sparkrecon.sources import ledger
from sparkrecon.streaming import queue


def test_leveled_join_takes_the_first_level_and_row(spark):
    probes = spark.createDataFrame([(1, "责字〔2025〕1971-2号"), (2, "责字（2025）7号"), (3, "none"), (4, None)], "id long, read string")
    rows = spark.createDataFrame([(5, "责字〔2025〕1971号"), (6, "责字[2025]7号"), (7, "责字〔2025〕7号")], "row_no long, notice string")
    key, other = T.notice_key(F.col("read")), T.notice_key(F.col("notice"))
    levels = [matching.Level("exact", F.nullif(key, F.lit("")), other), matching.Level("root", T.notice_root(key), other)]
    got = {r.id: (r.row_no, r.match_name, r.needs_review) for r in matching.leveled_join(probes, rows, levels, "id", "row_no").collect()}
    assert got == {1: (5, "root", False), 2: (6, "exact", False), 3: (None, None, True), 4: (None, None, True)}
    every = matching.leveled_join(probes, rows, levels, "id", "row_no", every=True).filter("id = 2").select("row_no").collect()
    assert sorted(r[0] for r in every) == [6, 7]


def test_suffix_and_substitution(spark):
    a = spark.createDataFrame([("责字3360号",), ("x",)], "a string")
    b = spark.createDataFrame([("穗萝岗责字3360号",), ("60号",)], "b string")
    assert [tuple(r) for r in matching.suffix_pairs(a, "a", b, "b", 4).collect()] == [("责字3360号", "穗萝岗责字3360号")]
    n = spark.createDataFrame([("1175",)], "n string")
    m = spark.createDataFrame([("1176",), ("1175",), ("1257",), ("117",)], "m string")
    assert [r.m for r in matching.substitution_neighbours(n, "n", m, "m").collect()] == ["1176"]


def test_cascade(spark):
    rows = [(1, 1, True, True, False), (1, 2, False, True, True), (2, 1, False, True, False), (2, 2, False, True, True), (4, 1, False, False, True)]
    rows += [(3, i, False, True, False) for i in range(4)]
    pairs = spark.createDataFrame(rows, "p long, r long, i boolean, n boolean, c boolean")
    got = sorted((r.p, r.r) for r in matching.cascade(pairs, "p", F.col("i"), F.col("n"), F.col("c")).collect())
    assert got == [(1, 1), (2, 2), (4, 1)]


def test_greedy_assignment_and_fill(spark):
    pairs = spark.createDataFrame([("f", 1, "a", 0.9), ("f", 1, "b", 0.8), ("f", 2, "a", 1.0), ("f", 2, "b", 0.5), ("f", 3, "a", 1.0)], "file string, page long, target string, s double")
    got = matching.assign_one_to_one(pairs, "file", "page", "target", [F.col("page"), F.col("s").desc()])
    assert sorted((r.page, r.target) for r in got.collect()) == [(1, "a"), (2, "b")]
    left = spark.createDataFrame([("f", 3), ("f", 4)], "file string, page long")
    right = spark.createDataFrame([("f", "c")], "file string, target string")
    assert [tuple(r) for r in matching.positional_fill(left, right, [F.col("page")], [F.col("target")], "file").collect()] == [("f", 3, "c")]


def test_ranges(spark):
    pages = spark.createDataFrame([("f", p, p in (1, 3)) for p in range(1, 5)] + [("g", p, p == 1) for p in range(1, 5)], "file string, page long, title boolean")
    got = segments.boundary_ranges(pages.withColumn("expected", F.lit(2)), "file", "page", F.col("title"), F.col("expected"), 2)
    assert sorted(map(tuple, got.collect())) == [("f", 1, 0, 2), ("f", 2, 2, 4), ("g", 1, 0, 2), ("g", 2, 2, 4)]
    files = spark.createDataFrame([("a", 6, 3), ("b", 3, 9), ("c", 1, 0)], "file string, pages int, n int")
    got = segments.fixed_ranges(files, "file", F.col("pages"), F.col("n"), 2)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0, 2), ("a", 2, 2, 4), ("a", 3, 4, 6), ("b", 1, 0, 2)]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", ""), (2, "b", "x")], "k long, u string, v string")
    new = spark.createDataFrame([(1, "", "new"), (3, "c", "y")], "k long, u string, v string")
    assert sorted(map(tuple, tables.write_back(old, new, "k", ["u", "v"]).collect())) == [(1, "a", "new"), (2, "b", "x")]
    assert sorted(map(tuple, tables.insert_or_ignore(old, new, "k").collect())) == [(1, "a", ""), (2, "b", "x"), (3, "c", "y")]
    assert sorted(map(tuple, tables.union_by_priority([new, old], "k").collect())) == [(1, "", "new"), (2, "b", "x"), (3, "c", "y")]
    status = {r.k: (r.status, r.missing) for r in tables.completeness(old.union(spark.createDataFrame([(4, None, "")], old.schema)), ["u", "v"]).collect()}
    assert status == {1: ("warning", "v"), 2: ("success", ""), 4: ("failed", "u,v")}


def test_statuses_and_reports(spark):
    rows = [(1, True, True, False, 1.0), (1, True, True, True, 1.0), (1, True, False, False, 0.9), (0, True, False, False, 1.0), (1, False, True, False, 1.0), (1, True, False, False, 0.2)]
    df = spark.createDataFrame(rows, "p int, f boolean, e boolean, r boolean, s double")
    df = df.select(reports.notice_status(*[F.col(c) for c in "pfers"]).alias("x")).select("x.*")
    assert [r.status for r in df.collect()] == ["PASS", "WARNING", "WARNING", "FAIL", "FAIL", "FAIL"]
    assert tuple(reports.status_summary(df, "status").first()) == (6, 1, 2, 3, 1 / 6)
    assert reports.status_summary(df.limit(0), "status").first()["pass_rate"] == 0.0


def test_ledgers(spark, tmp_path):
    sheet = spark.createDataFrame([("", "穗公积金中心南沙责字（2025） 1175号", "918-责催-x", "", " 甲公司 "), ("", "other", "1-责催-x", "", "b"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    assert [tuple(r)[1:] for r in ledger.cases(sheet).collect()] == [("918", "穗公积金中心南沙责字（2025）1175号", "甲公司")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("one\f \ftwo")
    assert [tuple(r) for r in ledger.text_pages(spark, str(tmp_path / "in")).collect()] == [("b.txt", 1, "one"), ("b.txt", 3, "two")]


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("source", "out", "check"))
    rows = lambda a, b: spark.createDataFrame([(i, i % 3, "error" if i % 2 else "done") for i in range(a, b)], "n long, task long, result string")

    def run():
        stream = spark.readStream.schema("n long, task long, result string").parquet(source)
        queue.run_available(stream, out, check, lambda b: queue.states(b, "task", "n", "result", "error", "done", 2)).awaitTermination()
        return spark.read.parquet(out).agg(F.sum("attempts")).first()[0]

    rows(0, 6).write.parquet(source)
    assert run() == 6
    rows(6, 10).write.mode("append").parquet(source)
    assert run() == 10
    assert run() == 10
