"""Queries with planted near misses: every rung of the ladders, output names, task statuses and checks of pages.

Names and numbers follow from keys, in such a way that how alike two of them are follows from what was planted: each place
of a name has characters of its own, so common blocks only ever stand at equal places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import rules
from sparkrecon.functions import text as T
from sparkrecon.operators import exports, ladders, matching, outputs, rungs
from sparkrecon.operators.similar import ratio_pairs
from sparkrecon.operators.store import shuffled
from sparkrecon.plans.catalogue import query
from sparkrecon.plans.flows import REGIONS, _region, _t
from sparkrecon.streaming import queue, tasks

_HEX = "0123456789abcdef"
ENDING = "科技发展有限公司"


def _name(c: Column, changed: Column, ending: str = ENDING) -> Column:
    """Twelve characters of the key's md5, each place with an alphabet of its own, so many of them (spread out) unreadable, and an ending."""
    md5 = F.md5(c.cast("string"))
    parts = []
    for i in range(12):
        own = F.translate(F.substring(md5, i + 1, 1), _HEX, "".join(chr(0x5000 + 16 * i + j) for j in range(16)))
        rank = (i * 5) % 12  # the order in which places become unreadable
        parts.append(F.when(changed > rank, chr(0x6000 + i)).otherwise(own))
    return F.concat(*parts, F.lit(ending))


@query("SELECT s_suppkey, c_custkey, (20 - s_suppkey % 6)::DOUBLE / 20 AS ratio FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 6 <= 3")
def near_names(spark, sf_dir):
    """Names of suppliers with none to five of twenty characters unreadable, against all customers: pairs down to a ratio of 0.85, not below."""
    ours = _t(spark, sf_dir, "supplier").select("s_suppkey", _name(F.col("s_suppkey"), F.col("s_suppkey") % 6).alias("a"))
    theirs = _t(spark, sf_dir, "customer").select("c_custkey", _name(F.col("c_custkey"), F.lit(0)).alias("b"))
    return ratio_pairs(ours, "a", theirs, "b", 0.85).join(shuffled(ours), "a").join(shuffled(theirs), "b").select("s_suppkey", "c_custkey", "ratio")


@query("""SELECT s_suppkey, c_custkey AS target_no, CASE s_suppkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'core' ELSE 'fuzzy' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 95.0 ELSE 0.9 END::DOUBLE AS score
          FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 4 < 3""")
def company_rungs_match(spark, sf_dir):
    """Companies to targets: equal names, names of one core, names of a ratio of 0.9, and names of 0.8, which match nothing."""
    k = F.col("s_suppkey") % 4
    name = F.when(k == 1, _name(F.col("s_suppkey"), F.lit(0), "科技发展股份有限公司")).otherwise(_name(F.col("s_suppkey"), F.when(k == 2, 2).when(k == 3, 4).otherwise(0)))
    names = _t(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    targets = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_no"), F.concat(_name(F.col("c_custkey"), F.lit(0)), F.lit(".pdf")).alias("target"))
    return names.join(shuffled(ladders.company_match(names, "name", targets, "target", "target_no")), "name").select("s_suppkey", "target_no", "kind", "score")


def _number(c: Column) -> Column:
    """Ten digits, another number for each key, without any order."""
    return (F.lit(1_000_000_000) + (c.cast("long") * 2654435761 + 987654321) % 1_000_000_000).cast("string")


def _id(c: Column, number: Column | None = None, region: Column | None = None, prefix: str = "穗公积金中心", tail: str = "") -> Column:
    return F.concat(F.lit(prefix), _region(c) if region is None else region, F.lit("责字〔2024〕"), _number(c) if number is None else number, F.lit(f"{tail}号"))


def _ids(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", _id(F.col("c_custkey")).alias("c_notice"))


def _misread(spark, sf_dir) -> DataFrame:
    """An order's reading of its customer's identifier, in eight kinds, from the identifier itself to nothing like it."""
    c, kind = F.col("o_custkey"), F.col("o_orderkey") % 8
    n = _number(c)
    last = F.translate(F.right(n, F.lit(1)), "0123456789", "1234567890")
    one_off = F.concat(F.left(n, F.lit(9)), last)
    read = (
        F.when(kind == 0, F.replace(F.replace(_id(c), F.lit("〔"), F.lit("(")), F.lit("〕"), F.lit(")"))).when(kind == 1, _id(c, tail="-7")).when(kind == 2, _id(c, one_off))
        .when(kind == 3, _id(c, F.concat(F.left(n, F.lit(5)), F.lit("0"), F.right(n, F.lit(5))))).when(kind == 4, _id(c, region=F.lit("某某")))
        .when(kind == 5, _id(c, one_off, F.concat(F.left(_region(c), F.lit(1)), F.lit("某"))))
        .when(kind == 6, _id(c, F.lit("1"), F.lit("某某"))).otherwise(_id(c, prefix="稚公积金中心"))
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", read.alias("read"))


@query("""SELECT o_orderkey, c_custkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE ['exact', 'root', 'smart_L2_L3', 'smart_L2_L3', 'structured', 'ratio', NULL, 'smart_L1'][(o_orderkey % 8 + 1)::INT] END AS match_name,
          c_custkey IS NULL OR o_orderkey % 8 IN (2, 3, 5) AS needs_review FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 8 <> 6""")
def id_ladder_rungs(spark, sf_dir):
    """Identifiers to the ledger by every rung: equal, another sub-number, a digit off, a digit too many, an unknown region, both wrong, nothing, and a learned word."""
    learned = spark.createDataFrame([("稚公积金中心", "穗公积金中心")], "original string, corrected string")
    found = ladders.id_ladder(_misread(spark, sf_dir), "read", "o_orderkey", _ids(spark, sf_dir), "c_notice", "c_custkey", learned)
    return found.select("o_orderkey", "c_custkey", "match_name", "needs_review")


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS c, o_orderkey % 6 AS k FROM orders), one AS (SELECT o.*, k = 4 AND (c + 1) % 10 <> 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = c + 1) AS told FROM o)
          SELECT o_orderkey::VARCHAR AS key, c_custkey AS row_no FROM one JOIN customer ON (c_custkey = c AND NOT told AND k <> 3 AND (k <> 1 OR c % 10 <> 0) AND (k <> 2 OR c % 10 = 0)) OR (c_custkey = c + 1 AND k = 4)""")
def rulings_cascade(spark, sf_dir):
    """Rulings by all evidence: the end of an identifier; a respondent read with a ratio of 0.85; one of many equal names that the court number
    settles, or does not; two identifiers of which the respondent tells one; the court number alone."""
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 6
    none = F.array().cast("array<string>")
    shared, court = F.lit("共同申请人科技发展有限公司"), lambda x: F.concat(F.lit("（2025）"), x.cast("string"))
    found = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.when(k == 0, F.array(F.concat(F.lit("责字〔2024〕"), _number(c), F.lit("号")))).when(k == 4, F.array(_id(c), _id(c + 1))).otherwise(none).alias("notice_numbers"),
        F.when(k == 1, F.array(_name(c, F.lit(3)))).when(k.isin(2, 3), F.array(shared)).when(k == 4, F.array(_name(c + 1, F.lit(0)))).otherwise(none).alias("respondents"),
        F.when(k.isin(2, 5), court(c)).otherwise("").alias("court_number"),
    )
    r = F.col("c_custkey")
    table = _t(spark, sf_dir, "customer").select(
        r.alias("row_no"), _id(r).alias("notice_number"), F.when(r % 10 == 0, shared).otherwise(_name(r, F.lit(0))).alias("respondent"), F.concat(F.lit("(2025)"), r.cast("string")).alias("court_number")
    )
    return ladders.rulings_to_ledger(found, table).select("key", "row_no")


def _pages(spark, sf_dir) -> tuple[DataFrame, Column, Column]:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return rows, F.col("n"), _id(F.col("conv_id"))


@query("""WITH p AS (SELECT conv_id, turn + 1 AS page, coalesce(length(text), 0) AS n FROM conversations),
          hits AS (SELECT conv_id, page, CASE WHEN n % 11 = 0 THEN 1 WHEN n % 11 IN (1, 2) THEN 2 WHEN n % 11 IN (3, 4) THEN 3 END AS rung FROM p WHERE page <= 3),
          best AS (SELECT conv_id, min((rung, page)) AS b FROM hits WHERE rung IS NOT NULL GROUP BY conv_id)
          SELECT c.conv_id, b IS NOT NULL AS success, ['pdfplumber', 'region_ocr', 'full_page_ocr'][coalesce(b[1], 3)] AS method, b[2] AS page, CASE WHEN b[1] = 2 THEN 'notice_header' END AS region, coalesce(b[1], 3) = 3 AS fallback,
          CASE WHEN b IS NULL THEN '未找到责令号' END AS error FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best USING (conv_id)""")
def notice_rungs(spark, sf_dir):
    """Identifiers of files: from the text layer, else page by page from headers, else from whole pages; some layers hold one of a wrong form."""
    rows, n, notice = _pages(spark, sf_dir)
    wrong = F.concat(F.lit("穗公积金中心，责字〔2024〕1号 "), n.cast("string"))
    layer = F.when(n % 11 == 0, F.concat(F.lit("关于 "), notice)).when(n % 11 == 5, wrong).otherwise("")
    header = F.when((n % 11).isin(1, 2), notice).otherwise("页眉")
    full = F.when((n % 11).isin(3, 4), F.concat(F.lit("全文\n"), notice, F.lit("。"))).otherwise("全文")
    return rungs.notice_ladder(rows, "conv_id", "page", layer, header, full).drop("value")


@query("""WITH p AS (SELECT conv_id, turn + 1 AS page, coalesce(length(text), 0) AS n FROM conversations),
          h AS (SELECT *, n % 5 IN (0, 2) AS upper, page % 2 = 1 AND n % 5 = 1 AS whole FROM p)
          SELECT conv_id, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (upper OR whole), '') AS starts, CASE WHEN bool_or(whole) THEN 'full_page_ocr' WHEN bool_or(upper) THEN 'region_ocr' END AS method,
          count(*) AS pages_checked, count(*) FILTER (whole) AS fallback_count FROM h GROUP BY conv_id""")
def application_rungs(spark, sf_dir):
    """First pages of applications: by the title in the upper region, else, of odd pages, in the whole page."""
    rows, n, _ = _pages(spark, sf_dir)
    title = F.when(n % 5 == 0, "强制执行申请书\n申请人").when(n % 5 == 2, "强制执行申请书").otherwise("附件")
    full = F.when(n % 5 == 1, "全文 强制执行申请书").otherwise("全文")
    found = rungs.application_ladder(rows, "conv_id", "page", title, full)
    return found.select("conv_id", F.array_join(F.col("start_pages").cast("array<string>"), ",").alias("starts"), "method", "pages_checked", "fallback_count")


@query("""WITH p AS (SELECT conv_id, turn + 1 AS page, coalesce(length(text), 0) AS n FROM conversations)
          SELECT conv_id, page, n % 7 < 5 AS success, CASE n % 7 WHEN 0 THEN concat('广州', conv_id, '号有限公司') WHEN 1 THEN concat('深圳', conv_id, '号集团') WHEN 2 THEN concat('佛山', conv_id, '号公司') WHEN 3 THEN '店' WHEN 4 THEN '海公司' END AS value,
          CASE WHEN n % 7 < 3 THEN 'region_ocr' ELSE 'full_page_ocr' END AS method, CASE n % 7 WHEN 0 THEN 'middle' WHEN 1 THEN 'top' WHEN 2 THEN 'bottom' END AS region, n % 7 >= 3 AS fallback, CASE WHEN n % 7 >= 5 THEN '未找到公司名称' END AS error
          FROM p WHERE n % 7 <> 3 UNION ALL SELECT conv_id, page, false, NULL, 'full_page_ocr', NULL, true, '未找到公司名称' FROM p WHERE n % 7 = 3""")
def company_rungs(spark, sf_dir):
    """Companies of pages: from the middle, the top, the bottom, else the whole page, whose name may be of any form (too short above)."""
    rows, n, _ = _pages(spark, sf_dir)
    c, k = F.col("conv_id").cast("string"), n % 7
    regions = {
        "middle": F.when(k == 0, F.concat(F.lit("名称："), F.lit(" 广州"), c, F.lit("号有限公司"))).when(k == 4, "海公司").otherwise("无"),
        "top": F.when(k == 1, F.concat(F.lit("深圳"), c, F.lit("号集团"))).when(k == 0, "不会读到公司").otherwise("无"), "bottom": F.when(k == 2, F.concat(F.lit("佛山"), c, F.lit("号公司"))).otherwise("无"),
    }
    full = F.when(k == 4, "海公司").when(k < 3, "不会读到的公司").otherwise("无")
    return rungs.company_ladder(rows, "conv_id", "page", regions, full)


@query("""WITH e AS (SELECT user_id AS task, event_id AS seq, event_type = 'purchase' AS ok, event_type AS error FROM events),
          w AS (SELECT task, min(seq) FILTER (ok) AS won FROM e GROUP BY task), f AS (SELECT e.task, seq, error, row_number() OVER (PARTITION BY e.task ORDER BY seq) AS n FROM e JOIN w USING (task) WHERE NOT ok AND (won IS NULL OR seq < won)),
          l AS (SELECT task, count(*) AS lost, arg_max(error, seq) AS error, max(seq) AS seq FROM f WHERE n <= 4 GROUP BY task)
          SELECT task::VARCHAR AS task, coalesce(lost, 0) + CASE WHEN coalesce(lost, 0) <= 3 AND won IS NOT NULL THEN 1 ELSE 0 END AS attempts, CASE WHEN lost > 3 THEN 'permanent' WHEN won IS NOT NULL THEN 'done' ELSE 'retry' END AS status,
          CASE WHEN coalesce(lost, 0) <= 3 AND won IS NOT NULL THEN '' ELSE error END AS error, CASE WHEN coalesce(lost, 0) <= 3 AND won IS NOT NULL THEN won ELSE seq END AS last FROM w LEFT JOIN l USING (task)""")
def task_statuses(spark, sf_dir):
    """Events as results of tasks, one a user: attempts, status and error as the stateful stream has them at its end."""
    results = _t(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"))
    return tasks.counted(results, 3)


@query("""WITH c AS (SELECT min(o_orderkey) AS cut FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 4001 = 3000), n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders),
          k AS (SELECT coalesce(min(place), 1000000000) AS cut FROM n JOIN c ON o_orderkey = cut)
          SELECT o_orderkey, CASE WHEN place < cut + 3 AND place % 4001 <> 3000 AND o_orderkey % 5 > 0 THEN 'success' ELSE 'failed' END AS status,
          CASE WHEN place >= cut + 3 OR (o_orderkey % 5 = 0 AND place % 4001 <> 3000) THEN 'not queried' WHEN place % 4001 = 3000 THEN 'depleted' ELSE '' END AS error FROM n, k""")
def back_fill(spark, sf_dir):
    """Names asked for in order, three at a time, until the balance has run out: what comes after that, or has no answer, is failed."""
    names = _t(spark, sf_dir, "orders").select("o_orderkey")
    placed = outputs.numbered(names, [F.col("o_orderkey")], "n")
    answers = placed.filter("o_orderkey % 5 > 0 or n % 4001 = 3000").select("o_orderkey", F.when(F.col("n") % 4001 == 3000, "failed").otherwise("success").alias("status"), F.when(F.col("n") % 4001 == 3000, "depleted").otherwise("").alias("error"))
    return queue.back_filled(names, answers, "o_orderkey", "o_orderkey", 3)


@query(f"""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS kind, (({REGIONS})[(o_custkey % 12 + 1)::INT]) AS r FROM orders),
           j AS (SELECT s.*, concat('穗公积金中心', r, '责字〔2024〕', 1000000000 + (c * 2654435761 + 987654321) % 1000000000, '号') AS target, c_custkey FROM s LEFT JOIN customer ON c = c_custkey AND kind < 3),
           n AS (SELECT *, CASE WHEN c_custkey IS NOT NULL AND kind = 1 THEN concat(c, '-责催-', target, '[实际', replace(target, '号', '-7号'), '].pdf') WHEN c_custkey IS NOT NULL THEN concat(c, '-责催-', target, '.pdf')
             ELSE concat('f', lpad(k::VARCHAR, 9, '0'), '_识别到[', CASE kind WHEN 1 THEN replace(target, '号', '-7号') WHEN 3 THEN '不是责令号' ELSE target END, ']_需人工核查.pdf') END AS name FROM j),
           u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS again FROM n)
           SELECT k AS o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN kind = 1 THEN 'same_root_base' ELSE 'exact' END AS match_type, coalesce(c_custkey IS NOT NULL AND kind = 1, false) AS same_root_remap,
           CASE WHEN c_custkey IS NULL THEN '需人工核查' ELSE '责催' END AS folder, CASE WHEN again > 0 THEN replace(name, '.pdf', concat('-', again, '.pdf')) ELSE name END AS name FROM u""")
def notice_exports(spark, sf_dir):
    """Orders as notices to export to the ledger's names: many of a customer, so that names are numbered; some of another number of one base."""
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 4
    detected = F.when(k == 1, _id(c, tail="-7")).when(k == 3, "不是责令号").otherwise(_id(c))
    sources = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".pdf")).alias("source"), detected.alias("detected"), F.lit(None).cast("string").alias("selected"))
    cases = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_custkey").cast("string").alias("sequence"), _id(F.col("c_custkey")).alias("notice_number"))
    return exports.notice_exports(sources, cases).select("o_orderkey", "match_type", "same_root_remap", "folder", "name")


@query("""SELECT conv_id, turn, CASE WHEN k = 0 THEN '申请书' ELSE '需人工核查' END AS folder, CASE k WHEN 0 THEN concat('c', conv_id, CASE WHEN r > 1 THEN concat('-', r - 1) ELSE '' END, '.pdf') WHEN 1 THEN concat('申请书_第', turn + 1, '-', turn + 2, '页_识别到[n_', conv_id, ']_匹配方式[relaxed]_需人工核查.pdf')
          WHEN 2 THEN concat('申请书_第', turn + 1, '-', turn + 2, '页_识别到[n_', conv_id, ']_未匹配台账_需人工核查.pdf') ELSE concat('申请书_第', turn + 1, '-', turn + 2, '页_未识别到责令号', CASE WHEN r > 1 THEN '' ELSE '' END, '_需人工核查.pdf') END AS plain, event FROM
          (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS r, CASE k WHEN 1 THEN 'application_needs_review' WHEN 2 THEN 'application_unmatched' WHEN 3 THEN 'application_unknown' END AS event FROM (SELECT conv_id, turn, (coalesce(length(text), 0) % 4) AS k FROM conversations))""")
def application_exports(spark, sf_dir):
    """Ranges of applications that are sure, to be looked at, unmatched or unread, with their names; the review folder's without their numbers."""
    k = F.coalesce(F.length("text"), F.lit(0)) % 4
    c = F.col("conv_id").cast("string")
    found = _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", c.alias("file"), F.col("turn").alias("start"), (F.col("turn") + 2).alias("end"), F.when(k < 2, F.concat(F.lit("c"), c, F.lit(".pdf"))).alias("target_name"),
        F.when(k < 3, F.concat(F.lit("n/"), c)).alias("read_as"), F.when(k == 0, "strict").otherwise("relaxed").alias("source"), (k > 0).alias("needs_review"),
    )
    out = exports.application_exports(found)
    plain = F.when(F.col("folder") == exports.LOOK, F.regexp_replace("name", r"-\d+\.pdf$", ".pdf")).otherwise(F.col("name"))
    return out.select("conv_id", "turn", "folder", plain.alias("plain"), "event")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS k FROM supplier)
          SELECT s_suppkey, CASE WHEN k = 0 AND c_custkey IS NOT NULL THEN c_custkey END AS target_no, CASE WHEN k = 0 AND c_custkey IS NOT NULL THEN '授权书' ELSE '需人工核查' END AS folder,
          CASE WHEN k = 0 AND c_custkey IS NOT NULL THEN 'company_name_match' WHEN k = 2 THEN 'company_name_unknown' ELSE 'company_name_unmatched' END AS event FROM p LEFT JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
def company_exports(spark, sf_dir):
    """Pages of nations' files to their companies: named on the page and in the file's targets, named only, or not named."""
    k = F.col("s_suppkey") % 3
    plain = lambda c: F.concat(F.translate(F.md5(c.cast("string")), _HEX, "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳"), F.lit("有限公司"))
    body = F.when(k == 0, F.concat(F.lit("委托人与"), plain(F.col("s_suppkey")), F.lit("关于强制执行一案"))).when(k == 1, "委托人与无此名称有限公司关于强制执行一案").otherwise("空白页")
    pages = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("page"), body.alias("text"))
    targets = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("target_no"), F.concat(plain(F.col("c_custkey")), F.lit(".pdf")).alias("target"))
    out = exports.company_exports(pages, targets, "file", "page", "text", "授权书")
    return out.select(F.col("page").alias("s_suppkey"), "target_no", "folder", "event")


@query("""SELECT doc_id, k = 0 AS title_ok, k = 1 AS notice_ok, k IN (2, 6) AS company_ok, CASE k WHEN 0 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'combined' END AS evidence,
          CASE k WHEN 0 THEN '申请执行人' ELSE NULL END AS party, CASE WHEN k = 5 THEN '催告书' END AS document_type, CASE WHEN k = 6 THEN '某某商店' WHEN k = 2 THEN '广州某某有限公司' END AS company, CASE WHEN k = 7 THEN 2 ELSE CASE WHEN k = 1 THEN 1 ELSE 0 END END AS n_strict, CASE WHEN k = 7 THEN 'b9' END AS surest
          FROM (SELECT doc_id, coalesce(length(text), 0) % 8 AS k FROM documents)""")
def page_checks(spark, sf_dir):
    """What single pages hold: titles, identifiers and companies of a right form, evidence of a first page, parties, kinds, all strict identifiers, all matches of a rule."""
    k = F.coalesce(F.length("text"), F.lit(0)) % 8
    title = F.when(k == 0, "强制执行申请书 申请人").otherwise("申请人")
    party = F.when(k == 3, "统一社会信用代码 法定代表人").when(k == 0, "申请执行人，住所地广州").otherwise("")
    body = F.when(k == 4, "关于强制执行申请的说明").when(k == 5, "催告书 合同").when(k == 7, F.concat(_id(F.lit(1)), F.lit("、"), _id(F.lit(2)), F.lit(" a1 b9"))).when(k == 1, _id(F.lit(3))).otherwise("")
    company = F.when(k == 2, "广州某某有限公司").when(k == 6, "某某商店").otherwise("无")
    hits = D.all_hits(F.when(k == 7, "b9").otherwise(""), [rules.Rule("letter", r"([a-z]\d)", 1.0, 1)])
    return _t(spark, sf_dir, "documents").select(
        "doc_id", D.valid_title(title).alias("title_ok"), D.valid_notice(F.when(k == 1, body).otherwise("穗公积金中心")).alias("notice_ok"), D.valid_company(company).alias("company_ok"),
        D.boundary(F.when(k == 0, title).otherwise(""), party, body)["evidence"].alias("evidence"), F.when(k == 0, D.party_name(party)).alias("party"), D.document_type(F.when(k == 5, body)).alias("document_type"),
        D.first_company(company).alias("company"), F.size(D.strict_notices(body)).alias("n_strict"), F.get(hits, 0)["value"].alias("surest"),
    )


@query()
def greedy_pairs(spark, sf_dir):
    """Orders to customers' names one to one, over the whole table as one group, by how far apart their amounts are: no task holds the group."""
    step = F.lit(2000.0)
    at = lambda c: F.floor(F.col(c) / step)
    a = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.array(at("s_acctbal") - 1, at("s_acctbal"), at("s_acctbal") + 1)).alias("at"))
    b = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", at("c_acctbal").alias("at"))
    apart = F.abs(F.col("s_acctbal") - F.col("c_acctbal"))
    pairs = a.join(b, "at").filter(apart < 2000).select(F.lit(1).alias("g"), "s_suppkey", "c_custkey", apart.alias("apart"))
    return matching.assign_one_to_one(pairs, "g", "s_suppkey", "c_custkey", [F.col("apart")], 1000).drop("g")
