"""Queries over notices, rulings and applications made from the driver's tables, and the flows that join them to a ledger.

Orders stand for documents that name a customer's notice, customers for the ledger. What each text holds follows from
its key, so the SQL states the result without parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import text as T
from sparkrecon.operators import ladders, layers, metrics, outputs, progress, reports, rulings
from sparkrecon.operators.store import shuffled
from sparkrecon.plans.catalogue import query
from sparkrecon.sources import ledger as sources
from sparkrecon.streaming import queue

REGIONS = "['番禺', '天河', '白云', '荔湾', '海珠', '越秀', '黄埔', '花都', '萝岗', '南沙', '从化', '增城']"
DIGITS = "['一', '二', '三', '四', '五', '六', '七', '八', '九']"
_REGION_SQL = f"({REGIONS})[(c % 12 + 1)::INT]"
#: Kinds of what an order's text says of its customer's notice.
_KIND = "o_orderkey % 6"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, D.REGIONS)), (c % 12).cast("int"))


def _notice(c: Column, open_: str = "〔", close: str = "〕", prefix: str = "穗公积金中心", word: str = "责字", tail: str = "", region: Column | None = None) -> Column:
    return F.concat(F.lit(prefix), _region(c) if region is None else region, F.lit(f"{word}{open_}2024{close}"), c.cast("string"), F.lit(f"{tail}号"))


def _read(spark, sf_dir) -> DataFrame:
    """An order's reading of its customer's notice: exact, sub-number, misread region, misread prefix, blank or nothing."""
    c, kind = F.col("o_custkey"), F.col("o_orderkey") % 6
    misread = F.when(_region(c) == "番禺", "番禹").otherwise(_region(c))
    read = (
        F.when(kind == 0, _notice(c, "（", "）")).when(kind == 1, _notice(c, tail="-2")).when(kind == 2, _notice(c, region=misread))
        .when(kind == 3, _notice(c, prefix="德公积金中心", word="贵字")).when(kind == 4, " ").otherwise("none")
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", read.alias("read"))


def _customers(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", _notice(F.col("c_custkey")).alias("c_notice"))


@query(f"""SELECT o_orderkey, {_REGION_SQL} AS region, CASE WHEN k < 3 THEN '2024' END AS year, CASE k WHEN 1 THEN concat(c, '-2') ELSE c::VARCHAR END AS number
           FROM (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders) WHERE k < 3""")
def strict_notices(spark, sf_dir):
    n = D.strict_notice(F.col("read"))
    return _read(spark, sf_dir).select("o_orderkey", n.alias("n")).filter("n is not null").select("o_orderkey", "n.region", "n.year", "n.number")


@query(f"""SELECT o_orderkey, concat('穗公积金中心', {_REGION_SQL}, '责字〔2024〕', c, CASE k WHEN 1 THEN '-2' ELSE '' END, '号') AS id
           FROM (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders) WHERE k < 2 UNION ALL
           SELECT o_orderkey, concat('穗公积金中心', CASE WHEN c % 12 = 0 THEN '番禹' ELSE {_REGION_SQL} END, '责字〔2024〕', c, '号') FROM (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders) WHERE k = 2""")
def decision_numbers(spark, sf_dir):
    return _read(spark, sf_dir).select("o_orderkey", F.explode(D.decision_numbers(F.concat(F.lit("附："), "read", F.lit("，")))).alias("id"))


@query(f"""SELECT o_orderkey, concat('穗公积金中心', {_REGION_SQL}, '责字', CASE k WHEN 0 THEN '（2024）' ELSE '〔2024〕' END, c, CASE k WHEN 1 THEN '-2' ELSE '' END, '号') AS id
           FROM (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders) WHERE k < 4""")
def relaxed_ids(spark, sf_dir):
    return _read(spark, sf_dir).select("o_orderkey", F.explode(D.relaxed_ids(F.concat(F.lit("，"), "read"))).alias("id"))


_NUMERAL_SQL = f"(CASE WHEN n >= 10 THEN concat(CASE WHEN n >= 20 THEN ({DIGITS})[n // 10] ELSE '' END, '十', CASE WHEN n % 10 > 0 THEN ({DIGITS})[n % 10] ELSE '' END) ELSE ({DIGITS})[n] END)"


def _numeral(n: Column) -> Column:
    digit = lambda x: F.coalesce(F.get(F.array(*map(F.lit, "一二三四五六七八九")), (x - 1).cast("int")), F.lit(""))
    ones = F.when(n % 10 > 0, digit(n % 10)).otherwise("")
    return F.when(n >= 10, F.concat(F.when(n >= 20, digit(F.floor(n / 10))).otherwise(""), F.lit("十"), ones)).otherwise(digit(n))


@query("SELECT o_orderkey, (o_orderkey % 99 + 1)::INT AS number, concat('2025年', o_orderkey % 12 + 1, '月', o_orderkey % 28 + 1, '日') AS day FROM orders")
def numerals_and_dates(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", _numeral(key % 99 + 1).alias("n"), F.concat(F.lit("二〇二五年"), _numeral(key % 12 + 1), F.lit("月"), _numeral(key % 28 + 1), F.lit("日")).alias("d"))
    return rows.select("o_orderkey", T.numeral(F.col("n")).alias("number"), D.dates_to_arabic(F.col("d")).alias("day"))


@query("""SELECT o_orderkey, '行政裁定书' AS document_type, concat('（2025）粤7101行审', o_orderkey, '号') AS court_number, CASE o_orderkey % 2 WHEN 0 THEN '张三' END AS judge, '李四' AS clerk,
          concat('2025年', o_orderkey % 12 + 1, '月', o_orderkey % 28 + 1, '日') AS day, concat('广州', o_custkey, '号有限公司') AS party FROM orders""")
def ruling_documents(spark, sf_dir):
    key = F.col("o_orderkey")
    body = F.concat(
        F.lit("行 政 裁 定 书\n( 2025 ) 粤 7101 行审 "), key.cast("string"), F.lit(" 号\n甲方：广州"), F.col("o_custkey").cast("string"), F.lit("号 有限公司，住所地广州\n"),
        F.when(key % 2 == 0, F.lit("审 判 员 张 三\n")).otherwise(""), F.lit("书 记 员 李 四\n二〇二五年"), _numeral(key % 12 + 1), F.lit("月"), _numeral(key % 28 + 1), F.lit("日"),
    )
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", D.processed(body)["text"].alias("t"))
    rows = rows.select("o_orderkey", D.ruling_fields(F.col("t")).alias("r"), D.contract_fields(F.col("t"))["party_a"].alias("party"))
    return rows.select("o_orderkey", "r.document_type", F.col("r.administrative_case_no").alias("court_number"), "r.judge", "r.clerk", F.col("r.execution_date").alias("day"), "party")


@query("""SELECT doc_id, contains(text, 'License') AND contains(text, 'License') AS main, doc_id % 3 = 0 AS delivery, CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 5 = 1 THEN true WHEN doc_id % 5 = 2 THEN false ELSE true END AS fallback,
          CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'region_text_too_short' WHEN 2 THEN 'weak_notice_signal_only' ELSE 'no_notice_signal' END AS reason FROM documents""")
def page_decisions(spark, sf_dir):
    key, body = F.col("doc_id"), F.col("text")
    page = F.concat(F.when(F.contains(body, F.lit("License")), "责令限期 办理决定书").otherwise(""), F.when(key % 3 == 0, "送达 回证").otherwise(""))
    read = F.when(key % 5 == 1, "ab").when(key % 5 == 2, "责字 and more than eight").otherwise("more than eight characters")
    rows = _t(spark, sf_dir, "documents").select("doc_id", D.page_profile(page).alias("p"), D.notice_fallback(read, F.when(key % 5 == 0, 1).otherwise(0)).alias("f"))
    return rows.select("doc_id", F.col("p.is_notice_main_page").alias("main"), F.col("p.is_notice_delivery_page").alias("delivery"), "f.fallback", "f.reason")


@query(f"""WITH p AS (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders)
           SELECT o_orderkey, c_custkey, CASE WHEN c_custkey IS NULL THEN NULL WHEN k = 0 THEN 'exact' WHEN k = 1 THEN 'root' WHEN k = 2 THEN CASE WHEN c % 12 = 0 THEN 'smart_L1' ELSE 'exact' END ELSE 'structured' END AS match_name,
           c_custkey IS NULL AS needs_review FROM p LEFT JOIN customer ON c = c_custkey AND k < 4""")
def id_ladder(spark, sf_dir):
    found = ladders.id_ladder(_read(spark, sf_dir), "read", "o_orderkey", _customers(spark, sf_dir), "c_notice", "c_custkey")
    return found.select("o_orderkey", "c_custkey", "match_name", "needs_review")


@query(f"""WITH p AS (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders)
           SELECT o_orderkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN k = 1 THEN 'root' WHEN k = 3 THEN 'relaxed' ELSE 'strict' END AS source, coalesce(k = 3, true) OR c_custkey IS NULL AS needs_review FROM p LEFT JOIN customer ON c = c_custkey AND k < 4""")
def text_ladder(spark, sf_dir):
    texts = _read(spark, sf_dir).select("o_orderkey", F.concat(F.lit("关于："), "read", F.lit("，申请执行")).alias("body"))
    return ladders.text_ladder(texts, "body", "o_orderkey", _customers(spark, sf_dir), "c_notice", "c_custkey").select("o_orderkey", "c_custkey", "source", "needs_review")


@query("SELECT s_suppkey, c_custkey AS target_no, 'core' AS kind, 95.0::DOUBLE AS score FROM supplier JOIN customer ON s_suppkey = c_custkey")
def company_match(spark, sf_dir):
    name = lambda c, end: F.concat(F.left(F.md5(F.col(c).cast("string")), F.lit(16)), F.lit(end))
    names = _t(spark, sf_dir, "supplier").select("s_suppkey", name("s_suppkey", "股份有限公司").alias("name"))
    targets = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_no"), name("c_custkey", "有限公司.pdf").alias("target"))
    found = ladders.company_match(names, "name", targets, "target", "target_no")
    return names.join(shuffled(found), "name").select("s_suppkey", "target_no", "kind", "score")


def _rulings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = F.col("o_custkey")
    found = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, F.array(_notice(c))).otherwise(F.array().cast("array<string>")).alias("notice_numbers"),
        F.when(F.col("o_orderkey") % 4 == 1, F.array(F.md5(c.cast("string")))).otherwise(F.array().cast("array<string>")).alias("respondents"),
        F.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("（2025）"), c.cast("string"))).otherwise("").alias("court_number"),
        F.lit("张三").alias("judge"), F.lit("李四").alias("clerk"), F.lit("二〇二五年四月八日").alias("ruling_date"), F.lit("准予强制执行").alias("result"),
    )
    k = F.col("c_custkey")
    table = _t(spark, sf_dir, "customer").select(
        k.alias("row_no"), _notice(k).alias("notice_number"), F.md5(k.cast("string")).alias("respondent"), F.concat(F.lit("(2025)"), k.cast("string")).alias("court_number"),
        _region(k).alias("region"), F.col("c_name").alias("employee"), F.col("c_acctbal").alias("amount"),
    )
    return found, table


@query("SELECT o_orderkey::VARCHAR AS key, c_custkey AS row_no FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 < 3")
def rulings_to_ledger(spark, sf_dir):
    found, table = _rulings(spark, sf_dir)
    return ladders.rulings_to_ledger(found, table).select("key", "row_no")


@query(f"""SELECT {REGIONS}[(c_custkey % 12 + 1)::INT] AS region, concat('穗公积金中心', {REGIONS}[(c_custkey % 12 + 1)::INT], '责字〔2024〕', c_custkey, '号') AS notice_number, '张三/李四' AS judges, '2025年4月8日' AS ruled_on, count(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 < 3 GROUP BY ALL""")
def enforcement_flow(spark, sf_dir):
    """Rulings and ledger to the sheet of matched rows, whole."""
    found, table = _rulings(spark, sf_dir)
    sheet = outputs.matched_sheet(found, table, ladders.rulings_to_ledger(found, table))
    return sheet.groupBy("region", "notice_number", "judges", "ruled_on").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT o_orderkey, o_custkey AS c, {_KIND} AS k FROM orders), m AS (SELECT * FROM p LEFT JOIN customer ON c = c_custkey AND k < 4)
           SELECT CASE WHEN k > 3 OR c_custkey IS NULL THEN 'FAIL' WHEN k = 1 THEN 'WARNING' WHEN k IN (2, 3) AND (k = 3 OR c % 12 = 0) THEN 'WARNING' ELSE 'PASS' END AS status, count(*) AS n FROM m GROUP BY ALL""")
def notice_flow(spark, sf_dir):
    """Documents with a reading and the ledger to validation statuses: an exact identifier passes, one of another number or repaired warns."""
    found = ladders.id_ladder(_read(spark, sf_dir), "read", "o_orderkey", _customers(spark, sf_dir), "c_notice", "c_custkey")
    name = F.coalesce("match_name", F.lit(""))
    status = reports.notice_status(F.lit(1), F.trim("read") != "", name == "exact", name == "root", F.when(name.isin("", "exact"), 0.0).otherwise(0.9))
    return found.select(status["status"].alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, row_number() OVER (ORDER BY event_id) AS number, CASE event_type WHEN 'click' THEN '未识别到公司名' ELSE '识别到的责令号未匹配台账' END AS problem FROM events WHERE event_type IN ('click', 'error')""")
def review_list(spark, sf_dir):
    event = F.when(F.col("event_type") == "click", "company_name_unknown").when(F.col("event_type") == "error", "application_unmatched").otherwise("other")
    audit = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), event.alias("event"), F.lit("所函").alias("doc_type"), F.lit("").alias("pages"), F.lit(1).alias("page"), F.lit("").alias("detected"), F.lit("").alias("matched_target"))
    return outputs.review_list(audit).select(F.col("seq").alias("event_id"), "number", "problem")


@query("SELECT row_number() OVER (ORDER BY event_id) AS number, concat('[', row_number() OVER (ORDER BY event_id), '] ', event_type, ' user_id=', user_id) AS line FROM events")
def audit_lines(spark, sf_dir):
    audit = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), "user_id")
    return outputs.audit_lines(audit, [F.col("event_id")], ["user_id"])


@query("""SELECT conv_id, count(*) AS page_count, count(*) FILTER (role = 'system') AS fallback_pages, round(avg((role = 'system')::INT), 4) AS fallback_rate, arg_max(turn, (length(text), -turn)) AS slowest_page FROM conversations GROUP BY conv_id""")
def document_summary(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("duration"), (F.col("role") == "system").alias("fallback"), F.lit(1).alias("attempts"), F.lit(0.5).alias("region_seconds"))
    return metrics.document_summary(pages, "conv_id", "turn").select("conv_id", "page_count", "fallback_pages", "fallback_rate", "slowest_page")


@query("""WITH t AS (SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'und')::INT + contains(text, 'que')::INT) * 100.0::DOUBLE / 3 AS keyword_rate, (length(text) - length(replace(text, 'the ', '')))::DOUBLE / 4 AS n FROM documents)
          SELECT doc_id, keyword_rate, n::INT AS detected, CASE WHEN n <= 4.5 THEN least(n / 3 * 100, 100.0) ELSE 50.0 END AS detection_accuracy, CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM t""")
def keyword_metrics(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return metrics.keyword_metrics(docs, "doc_id", "text", ["the", "und", "que"], "the ", F.lit(3), F.lit(0)).drop("boundary_rate")


@query("SELECT source AS doc_type, count(*) AS files, sum(n_chars)::BIGINT AS pages, CASE WHEN sum(n_chars) // 2 = 50 THEN 'OK' ELSE 'WARN' END AS status FROM documents GROUP BY source")
def input_check(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("source").alias("doc_type"), F.col("doc_id").cast("string").alias("file"), F.col("n_chars").alias("pages"))
    per = files.select("doc_type").distinct().select("doc_type", F.lit(2).alias("per"))
    return metrics.input_check(files, F.lit(50), per).select("doc_type", "files", "pages", "status")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) AS n_pages FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def merged_results(spark, sf_dir):
    tasks = _t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text", F.lit(1.0).alias("duration"))
    return metrics.merged_results(tasks, "conv_id", ["turn"]).select("conv_id", F.md5("full_text").alias("text_md5"), "n_pages")


@query("SELECT o_orderpriority AS batch, count(*) AS total, count(*) FILTER (o_orderkey % 3 > 0) AS passed, coalesce(round((count(*) FILTER (o_orderkey % 3 > 0))::DOUBLE / nullif(count(*), 0), 4), 0.0) AS pass_rate FROM orders GROUP BY ROLLUP (o_orderpriority)")
def run_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.lit(1).cast("long").alias("total"), (F.col("o_orderkey") % 3 > 0).cast("long").alias("passed"))
    return metrics.run_rollup(rows, "batch", ["total", "passed"], "passed", "total")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def newest_tasks(spark, sf_dir):
    return metrics.newest(_t(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT folder, list(name ORDER BY c_custkey)::VARCHAR IS NOT NULL AS named, count(*) AS n, md5(string_agg(name, '|' ORDER BY c_custkey)) AS names_md5 FROM (SELECT c_custkey, unnest(['责催', '授权书']) AS folder, unnest([concat(c_custkey, '-责催-', c_name, '.pdf'), concat(c_name, '.pdf')]) AS name FROM customer) GROUP BY folder")
def expected_outputs(spark, sf_dir):
    cases = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), "c_name")
    named = [("责催", F.concat(F.col("row_no").cast("string"), F.lit("-责催-"), "c_name", F.lit(".pdf"))), ("授权书", F.concat("c_name", F.lit(".pdf")))]
    return outputs.expected_outputs(cases, named).select("folder", F.lit(True).alias("named"), F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|")).alias("names_md5"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '（曾用名：old', c_custkey, '）') ELSE c_name END AS current_name,
          CASE WHEN c_custkey % 2 = 0 THEN concat('street of ', c_name) ELSE concat('GD', 'GZ', 'TH') END AS location FROM customer""")
def company_records(spark, sf_dir):
    key = F.col("c_custkey")
    data = F.map_filter(
        F.create_map(F.lit("Address"), F.when(key % 2 == 0, F.concat(F.lit("street of "), "c_name")).otherwise(""), F.lit("Province"), F.lit("GD"), F.lit("City"), F.lit("GZ"), F.lit("District"), F.lit("TH")),
        lambda k, v: v != "",
    )
    old = F.when(key % 3 == 0, F.concat(F.lit("old"), key.cast("string"))).otherwise(F.lit(""))
    return _t(spark, sf_dir, "customer").select("c_custkey", D.current_name(F.col("c_name"), old).alias("current_name"), D.location(data).alias("location"))


@query("""WITH a AS (SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id),
          s AS (SELECT CASE WHEN last = 'error' AND attempts > 60 THEN 'permanent' WHEN last = 'error' THEN 'retry' WHEN last = 'purchase' THEN 'done' ELSE 'pending' END AS state FROM a)
          SELECT count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'retry') AS retry, count(*) FILTER (state = 'permanent') AS permanent, count(*) FILTER (state = 'pending') AS pending,
          (count(*) FILTER (state IN ('done', 'permanent')))::DOUBLE / count(*) AS progress FROM s""")
def task_progress(spark, sf_dir):
    states = queue.states(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type", failed="error", done="purchase", most=60)
    return queue.progress(states)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract(text, '([A-Z][a-z]{6,})', 1) AS cap, regexp_extract(text, '([a-z]{4,}ing)', 1) AS ing, regexp_extract(text, '(\d{1,9})', 1) AS num FROM documents)
           SELECT doc_id, CASE WHEN cap <> '' THEN cap WHEN ing <> '' THEN ing END AS word, CASE WHEN cap <> '' THEN 'capital' WHEN ing <> '' THEN 'ending' END AS source,
           CASE WHEN cap <> '' THEN 0.9::DOUBLE * (CASE WHEN length(cap) > 100 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) WHEN ing <> '' THEN 0.6::DOUBLE * (CASE WHEN length(ing) > 100 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) END AS confidence,
           CASE WHEN num <> '' THEN num::BIGINT::VARCHAR END AS figure FROM t""")
def layered_rules(spark, sf_dir):
    """Rules of two layers over whole texts: the rule 'ending' of the first layer takes the place of the second layer's."""
    rules = [
        (1, 0, "word", "capital", r"([A-Z][a-z]{6,})", 0.9, 1, None), (1, 1, "word", "ending", r"([a-z]+tion)", 0.95, 1, None),
        (0, 1, "word", "ending", r"([a-z]{4,}ing)", 0.6, 1, None), (1, 0, "figure", "digits", r"(\d{1,9})", 1.0, 1, "parse_amount"),
    ]
    found = layers.extracted(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", spark.createDataFrame(rules, layers.RULE_ROWS))
    return found.select("doc_id", F.col("word.value").alias("word"), F.col("word.source").alias("source"), F.col("word.confidence").alias("confidence"), F.col("figure.value").alias("figure"))


@query("""SELECT 1 AS number, 'read' AS phase, count(*) AS n_rows, (count(*) FILTER (event_type = 'error'))::DOUBLE AS errors FROM events
          UNION ALL SELECT 2, 'users', count(*), (count(*) FILTER (worst > 0))::DOUBLE FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS worst FROM events GROUP BY user_id)""")
def phase_summary(spark, sf_dir):
    """What the phases of a run counted while they ran."""
    run = progress.Run(spark, "events")
    events = run.phase("read", _t(spark, sf_dir, "events").select("user_id", "event_type"), errors=F.count_if(F.col("event_type") == "error"))
    run.phase("users", events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("worst")), errors=F.count_if(F.col("worst") > 0))
    return run.summary().select("number", "phase", F.col("rows").alias("n_rows"), F.try_element_at("counts", F.lit("errors")).alias("errors"))


@query("SELECT c_custkey AS key, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS row_no FROM customer WHERE c_custkey % 7 > 0 QUALIFY row_no BETWEEN 3 AND 40")
def names_between(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")).alias("c_name"))
    found = sources.names_between(rows, "c_name", F.col("c_custkey"), 3, 40)
    return rows.join(found, F.col("c_name") == F.col("name")).select(F.col("c_custkey").alias("key"), "name", "row_no")


@query("SELECT conv_id, count(*) AS pages, md5(string_agg(concat('=== 第', turn, '页 ===', chr(10), text), chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def whole_documents(spark, sf_dir):
    pages = _t(spark, sf_dir, "conversations").filter("text is not null")
    return sources.page_counts(pages, "conv_id").join(sources.whole_text(pages, "conv_id", "turn", "text"), "conv_id").select("conv_id", "pages", F.md5("full_text").alias("text_md5"))


@query("""SELECT o_orderkey, concat('（2025）粤7101行审', o_orderkey, '号') AS court_number, CASE WHEN o_orderkey % 2 = 0 THEN '撤回执行' ELSE '准予强制执行' END AS result, (1000 + o_orderkey)::DOUBLE AS amount,
          '2025年4月28日' AS ruling_date, '王明' AS judge FROM orders""")
def ruling_extract(spark, sf_dir):
    """Rulings as they are read: court number, result (a withdrawal overrides), amount, date and judge."""
    key = F.col("o_orderkey")
    body = F.concat(
        F.lit("（2025）粤 7101 行审"), key.cast("string"), F.lit("号\n欠缴住房公积金"), (key + 1000).cast("string"), F.lit("元，准予强制执行。"),
        F.when(key % 2 == 0, "申请人撤回强制执行。").otherwise(""), F.lit("\n裁定如下\n审判员王明\n—二〇二五年四月二十八日\n书记员李四"),
    )
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", rulings.ruling(body).alias("r"))
    return rows.select("o_orderkey", "r.court_number", "r.result", "r.amount", "r.ruling_date", "r.judge")
