"""Columns on fixture rows in the notices' own script."""

from pyspark.sql import functions as F

from sparkrecon.functions import rules
from sparkrecon.functions import text as T
from sparkrecon.functions import similarity


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("o")).first()["o"]


def test_corrections_are_ordered_and_shadowed(spark):
    assert one(spark, "天何区【2025】番禹", lambda c: T.correct(c, T.CORRECTIONS)) == "天河区〔2025〕番禺"
    assert T.merge_rules([("a", "1")], [("a", "2"), ("b", "3")]) == [("a", "1"), ("b", "3")]
    assert one(spark, "ab", lambda c: T.correct(c, [("a", "b"), ("bb", "x")])) == "x"
    assert one(spark, "right wrong", lambda c: T.correct_once(c, [("wrong", "right")])) == "right wrong"
    assert one(spark, "wrong right", lambda c: T.correct_once(c, [("wrong", "right")])) == "right right"


def test_bracket_forms_are_one_notice(spark):
    for a, b in ("（）", "〔〕", "[]", "()", "［］", "【】"):
        text = f"见穗公积金中心越秀责字{a}2024{b}914-1号。"
        assert one(spark, text, lambda c: F.array_join(T.notices(c), "|")) == f"穗公积金中心越秀责字{a}2024{b}914-1号"
        assert one(spark, f"穗公积金中心萝岗责字{a}2023{b} 3360号", T.notice_key) == "穗公积金中心萝岗责字〔2023〕3360号"


def test_notice_ranges_come_first(spark):
    text = "穗公积金中心南沙责字（2025）8号，穗公积金中心南沙责字（2025）3号至5号"
    head = "穗公积金中心南沙责字（2025）"
    assert one(spark, text, T.notices) == [f"{head}{n}号" for n in (3, 4, 5, 8)]
    assert one(spark, f"{head}3号至99号", T.notices) == [f"{head}3号"]


def test_identifiers(spark):
    assert one(spark, "穗公积金中心南沙责字〔2025〕1971-2号", T.notice_root) == "穗公积金中心南沙责字〔2025〕1971号"
    assert one(spark, "稳公积金中心越矛贵字〔2023〕5号", T.repair_notice) == "穗公积金中心越秀责字〔2023〕5号"
    assert one(spark, "穗公积金中心越秀责字〔2024〕562号", lambda c: F.to_json(T.notice_parts(c))) == '{"prefix":"穗公积金中心","district":"越秀","year":"2024","number":"562"}'
    assert one(spark, "other", T.notice_parts) is None
    assert one(spark, "罗岗", T.district) == "萝岗" and one(spark, "nowhere", T.district) is None
    assert one(spark, ["a责字1号", "责字1号", "b"], T.without_short_forms, "array<string>") == ["a责字1号", "b"]


def test_company_names(spark):
    assert one(spark, "广州 吾能学 网络\n科技（广州） 有限公司", T.company_key) == "广州吾能学网络科技(广州)有限公司"
    assert one(spark, "甲股份有限公司", T.company_core) == "甲"
    assert one(spark, "甲有限公司乙分公司", T.suffixes_in) == ["有限公司", "分公司"]
    assert one(spark, None, T.company_key) == ""


def test_numerals_and_dates(spark):
    for text, n in {"二〇二五": 2025, "十": 10, "十二": 12, "三十": 30, "二十一": 21, "一百二十": 120, "五": 5, "x": None, "": None}.items():
        assert one(spark, text, T.numeral) == n, text
    assert one(spark, "于二○二五年十二月三十一日作出", T.chinese_date) == "2025年12月31日"
    assert one(spark, "no date", T.chinese_date) is None


def test_small_fields(spark):
    assert one(spark, "15,000，5 0", T.amount) == 1500050.0 and one(spark, "x", T.amount) is None
    assert one(spark, 28000.0, T.amount_text, "double") == "28000" and one(spark, 2.5, T.amount_text, "double") == "2.5"
    assert one(spark, "王小明二〇二", T.person) == "王小明" and one(spark, "一", T.person) == "一"
    assert one(spark, "公 积　金 ok go", T.join_cjk) == "公积金 ok go"
    assert one(spark, "　 a  b \n\n\n\n c　", T.tidy) == "a b\n\nc"
    assert one(spark, "AA", T.column_number) == 27
    assert one(spark, "b10.pdf", T.natural_key) > one(spark, "b9.pdf", T.natural_key)


def test_best_rule_wins(spark):
    found = [rules.Rule("a", "x(\\d+)", 1.0), rules.Rule("b", "y(\\d+)", 0.9)]
    hit = one(spark, "x1 y12345", lambda c: F.to_json(rules.best_hit(c, found).dropFields("rank")))
    assert hit == '{"ord":1,"value":"12345","confidence":0.9,"source":"b"}'
    assert one(spark, "none", lambda c: rules.best_hit(c, found)) is None


def test_similarities(spark):
    from difflib import SequenceMatcher

    rows = [("abcd", "bcde"), ("", ""), (None, "a"), ("越秀", "越矛")]
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.block_ratio("a", "b"), similarity.indel_ratio("a", "b")).collect()
    assert [r[0] for r in got] == [0.0 if a is None else SequenceMatcher(None, a, b).ratio() for a, b in rows]
    assert [r[1] for r in got] == [75.0, 100.0, 0.0, 50.0]
