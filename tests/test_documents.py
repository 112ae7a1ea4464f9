"""Text of documents, and streams against their batch result."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.operators import rulings
from sparkrecon.streaming import queue

HEAD = "穗公积金中心"


def of(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_clean_up(spark):
    got = of(spark, "( 2025 ) 粤 7101 行审 12 号 " + HEAD + "天河责字 [ 2024 ] 12-3 号", D.case_numbers)
    assert got.text == "（2025）粤7101行审12号 " + HEAD + "天河责字〔2024〕12-3号"
    assert [x.kind for x in got.found] == ["法院案号", "决定书编号"]
    assert of(spark, "审 判 员 张 三 住 房公积 金", D.common_errors) == "审判员张三 住房公积金"
    assert of(spark, "广东 润生 箱包 制造 有限公司", D.company_spacing) == "广东润生箱包制造有限公司"
    assert of(spark, "附：" + HEAD + "天河责字(2024) 5 号准予", D.decision_number) == HEAD + "天河责字〔2024〕5号"
    assert of(spark, f"{HEAD}天河责字〔2024〕8号至 10号，{HEAD}天河责字〔2024〕9号、{HEAD}番禺责字〔2024〕3-1号", D.decision_numbers) == [f"{HEAD}天河责字〔2024〕{i}号" for i in (8, 9, 10)] + [f"{HEAD}番禺责字〔2024〕3-1号"]
    assert of(spark, "金额 12 元 （ 2025 ）粤 3 号 a b", D.despaced) == "金额12元（2025）粤3号 a b"
    assert of(spark, "甲公司，住所地广州，法定代表人乙", D.party_name) == "甲公司"


def test_fields(spark):
    assert of(spark, "名称：广州甲乙有限公司。", D.notice_fields).company_name == "广州甲乙有限公司"
    assert of(spark, "我单位与广州甲乙有限公司关于强制执行", D.target_company) == "广州甲乙有限公司"
    assert [of(spark, d, D.district) for d in ("番禹", "天河", "天大河", "东莞", "越矛")] == ["番禺", "天河", "天河", None, "越秀"]
    assert of(spark, f"稳公积金中心番禹贵字〔2024〕7号 {HEAD}番禺责字(2024)7号", D.relaxed_ids) == [f"{HEAD}番禺责字〔2024〕7号"]
    assert of(spark, "甲乙有限公司", D.valid_company) and not of(spark, "甲 乙有限公司", D.valid_company) and of(spark, None, D.valid_company) is False
    data = spark.createDataFrame([({"Address": "ab", "RegLoc": "a long street", "City": "GZ"},)], "m map<string,string>")
    assert data.select(D.location(F.col("m")).alias("x")).first().x == "a long street"
    hit = of(spark, "执行标的12元，5000元", rulings.with_confidence)
    assert hit.amount.value == "5000" and not hit.is_withdrawn and hit.court_number is None


def test_page_decisions(spark):
    rows = spark.createDataFrame([("强制执行申请书", "", "x"), ("", "法定代表人 被执行人", "x"), ("", "", "申请执行书"), ("", "", "x")], "a string, b string, c string")
    got = [r.x.evidence for r in rows.select(D.boundary(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == ["primary", "secondary", "combined", None]
    f = D.application_fallback(F.lit(True), F.col("a"), F.col("b"), F.col("c"), F.lit(True), F.lit(False))
    assert [r.x.reason for r in rows.select(f.alias("x")).collect()] == [None, "secondary_evidence_found", None, "boundary_candidate_text_short"]
    use = D.region_usable(F.lit("授权 x"), F.lit(None).cast("int"), ["授权委托书"], ["授权", "委托"])
    assert spark.range(1).select(use.alias("x")).first().x is False
    c = spark.range(1).select(D.company_fallback(F.lit("abc"), F.lit(False), F.lit(False)).alias("x")).first().x
    assert (c.fallback, c.reason) == (True, "region_text_too_short")


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 3, start + timedelta(minutes=7 * i), float(i)) for i in range(200)]
    late = [(1000, 0, start + timedelta(minutes=7 * 190), 1.0), (1001, 1, start, 1.0)]  # within the watermark, and long after it
    kind = "n long, user long, ts timestamp, value double"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(source)

    def streamed(f, name, mode):
        query = f(spark.readStream.schema(kind).parquet(source)).writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode)
        query = query.option("checkpointLocation", str(tmp_path / name / "check")).option("path", str(tmp_path / name / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / name / "out"))

    for name, f in (("tumbling", lambda d: queue.tumbling(d, "ts", "1 hour", "user", "value")), ("sessions", lambda d: queue.sessions(d, "ts", "10 minutes", "user"))):
        streamed(f, name, "append")
        spark.createDataFrame(late, kind).coalesce(1).write.mode("append").parquet(source) if name == "tumbling" else None
        spark.createDataFrame([(2000, 9, start + timedelta(days=9), 0.0)], kind).coalesce(1).write.mode("append").parquet(source) if name == "tumbling" else None
        got = sorted(map(tuple, streamed(f, name, "append").collect()))
        used = rows + [late[0]] if name == "tumbling" else rows + late  # the second run of tumbling drops what comes after the watermark
        batch = sorted(map(tuple, f(spark.createDataFrame(used, kind)).collect()))
        closed = [r for r in batch if r in got]
        assert got == closed and len(got) >= len(batch) - 3 * 2


def test_fingerprint_and_progress(spark):
    files = spark.createDataFrame([("a", "a|1|2"), ("b", "b|1|2")], "name string, cache_key string")
    assert queue.fingerprint(files) == queue.fingerprint(files.orderBy(F.col("name").desc())) != queue.fingerprint(files.limit(1))
    names = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, row_no int")
    done = spark.createDataFrame([("a", "success", ""), ("b", "failed", "depleted"), ("c", "success", "")], "name string, status string, error string")
    back = lambda results, window: sorted((r.name, r.status, r.error) for r in queue.back_filled(names, results, "name", "row_no", window).collect())
    assert back(done, 1) == [("a", "success", ""), ("b", "failed", "depleted"), ("c", "failed", "not queried")]
    assert back(done, 2)[2] == ("c", "success", "") and back(done.filter("name = 'a'"), 1)[2] == ("c", "failed", "not queried")
    made = queue.tasks(spark.createDataFrame([("所函", "10.pdf", 2), ("所函", "9.pdf", 1)], "doc_type string, file string, at int"), [F.col("at")])
    assert sorted((r.created, r.task, r.state) for r in made.collect()) == [(1, "所函|9.pdf", "pending"), (2, "所函|10.pdf", "pending")]
