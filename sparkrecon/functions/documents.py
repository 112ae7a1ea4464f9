"""What pages of notices, rulings, applications and contracts say, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrecon.functions import rules
from sparkrecon.functions import text as T

# Words, labels and forms of the documents.
SPACED_WORDS = (
    "住房公积金", "有限公司", "统一社会信用代码", "法定代表人", "委托代理人", "申请执行人", "被执行人", "审判员", "书记员",
    "行政裁定书", "责令限期办理决定书", "催告书",
)
OFFICERS = ("审判员", "书记员")
COMPANY_WORDS = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "集团公司", "股份公司", "事务所", "管理中心", "研究院", "协会", "中心", "公司")
KNOWN_NAMES = (
    (r"广东\s*润生\s*箱包\s*制造\s*有限公司", "广东润生箱包制造有限公司"),
    (r"三菱\s*电机\s*[(（]\s*广州\s*[)）]\s*压缩机\s*有限公司", "三菱电机（广州）压缩机有限公司"),
    (r"广州\s*住房\s*公积金\s*管理\s*中心", "广州住房公积金管理中心"),
    (r"广东\s*省\s*新闻\s*工作\s*者\s*协会", "广东省新闻工作者协会"),
    (r"广东\s*岭南\s*律师\s*事务所", "广东岭南律师事务所"),
)
DOCUMENT_TYPES = ("行政裁定书", "责令限期办理决定书", "催告书", "授权委托书", "合作协议", "合同")
PARTY_LABELS = ("，住所地", ",住所地", "，统一社会信用代码", ",统一社会信用代码", "，法定代表人", ",法定代表人", "，职务", ",职务", "，住所", ",住所", "，地址", ",地址")
ADDRESS_KEYS = ("CompanyAddress", "Address", "RegAddress", "OfficeAddress", "Domicile", "RegisteredAddress", "DetailAddress", "住所", "住所地", "注册地址", "经营地址", "地址")
ADDRESS_WORDS = ("addr", "Addr", "地址", "住所", "位置", "loc", "Loc", "domicile", "Domicile")
STRICT = r"(穗公积金中心)([一-龥]{2})(责字|贵字|责)[〔\[(［【（](\d{4})[〕\)\]］】）](\d+(?:-\d+)?)号?"
RELAXED = r"[一-鿿]{1,2}公积金中心[一-鿿]{2,4}[责贵]字[〔\[(［【（]\d{4}[〕\)\]］】）]\d+(?:-\d+)?号"
REGION_CORRECTIONS = (("番禹", "番禺"), ("天何", "天河"), ("白去", "白云"), ("荔弯", "荔湾"), ("海猪", "海珠"), ("越莠", "越秀"), ("黄浦", "黄埔"), ("花者", "花都"))
REGIONS = ("番禺", "天河", "白云", "荔湾", "海珠", "越秀", "黄埔", "花都", "萝岗", "南沙", "从化", "增城")
BOUNDARY_WORDS = ("强制执行申请书", "申请执行书", "强制执行申请")
BOUNDARY_EVIDENCE = ("统一社会信用代码", "法定代表人", "申请执行人", "被执行人")
_NAME = "[一-龥A-Za-z0-9（）()·]"
_ENDINGS = ("有限责任公司", "股份有限公司", "有限公司")
_COMPANY = f"({_NAME}+?(?:" + "|".join([f"{e}{_NAME}*分公司" for e in _ENDINGS] + list(_ENDINGS)) + "))"
CANDIDATES = tuple(head + _COMPANY for head in ("委托人与", "关于", r"名称[:：]\s*", r"委托单位[:：]\s*"))
FIRST_COMPANY = (r"([^\s，。；、《》]+?(?:有限公司|股份有限公司|集团|公司))", r"([^\s，。；、《》]+?分公司)", r"([^\s，。；、《》]+?(?:厂|店|中心|研究院))")


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return _some(F.regexp_extract(c, pattern, group))


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    return T.hits(c, words) > 0


def common_errors(c: Column) -> Column:
    """Full-width letters and digits as ASCII, keywords and officers' names without white space in them."""
    c = T.halfwidth(c)
    for word in SPACED_WORDS:
        c = F.regexp_replace(c, r"(?U)" + r"\s*".join(word), word)
    for officer in OFFICERS:
        c = F.regexp_replace(c, rf"(?U){officer}\s*([一-龥])\s*([一-龥])", rf"{officer}$1$2")
    return c


def case_numbers(c: Column) -> Column:
    """struct<text, found>: court and decision numbers in their usual form, and what was found of either, in order."""
    court = r"[(\[]\s*(\d{4})\s*[)\]]\s*(粤|穗)\s*(\d+)\s*(行审|民初|刑初|执|行)\s*(\d+)\s*号"
    decision = r"(.{2,30}?字)\s*[\[(]\s*(\d{4})\s*[\])]\s*(\d+(?:-\d+)?)\s*号"
    text = F.regexp_replace(c, court, "（$1）$2$3$4$5号")
    parts = lambda of, pattern, n: F.arrays_zip(*[_all(of, pattern, i).alias(f"p{i}") for i in range(1, n + 1)])
    courts = F.transform(parts(c, court, 5), lambda x: F.struct(F.lit("法院案号").alias("kind"), F.concat(F.lit("（"), x["p1"], F.lit("）"), x["p2"], x["p3"], x["p4"], x["p5"], F.lit("号")).alias("formatted")))
    decisions = F.transform(parts(text, decision, 3), lambda x: F.struct(F.lit("决定书编号").alias("kind"), F.concat(x["p1"], F.lit("〔"), x["p2"], F.lit("〕"), x["p3"], F.lit("号")).alias("formatted")))
    return F.struct(F.regexp_replace(text, decision, "$1〔$2〕$3号").alias("text"), F.concat(courts, decisions).alias("found"))


def company_spacing(c: Column) -> Column:
    """No white space before a company's ending, and some names as they are written."""
    for word in COMPANY_WORDS:
        c = F.regexp_replace(c, rf"(?U)(\S+)\s+{word}", rf"$1{word}")
    for pattern, name in KNOWN_NAMES:
        c = F.regexp_replace(c, pattern, name)
    return c


def decision_number(c: Column) -> Column:
    """From the first 穗, 粤 or 广 to the first 号, without labels and white space, brackets as 〔〕."""
    c = F.regexp_replace(T.strip(c), "^[^穗粤广]*", "")
    c = F.regexp_replace(F.regexp_replace(c, "^(?:附：|附件：|准予强制执行)", ""), r"^\d+\s*", "")
    c = F.translate(F.regexp_replace(c, r"(?U)\s+", ""), "()[]（）", "〔〕〔〕〔〕")
    return F.regexp_replace(c, "(?s)号.*$", "号")


def decision_numbers(c: Column) -> Column:
    """All decision numbers in one form, those of ranges first, each once. A range of sub-numbers counts if it is one number."""
    same = F.arrays_zip(*[_all(c, rf"({T.NOTICE_HEAD})(\d+-\d+)号至\s*(\d+-\d+)号", i).alias(f"p{i}") for i in (1, 2, 3)])
    same = F.transform(F.filter(same, lambda x: x["p2"] == x["p3"]), lambda x: F.concat(x["p1"], x["p2"], F.lit("号")))
    return F.array_distinct(F.transform(F.concat(same, T.notices(c)), decision_number))


def despaced(c: Column) -> Column:
    """Without white space between Chinese characters, or between them and digits, marks and brackets."""
    wide = "[一-鿿　-〿＀-￯]"
    marks = "[，。；：、！？…—（）《》〔〕【】［］\"]"
    pairs = ((wide, wide), ("[一-鿿]", marks), ("[一-鿿]", r"\d"), (r"\d", "[一-鿿]"), ("[（(]", r"\d{4}"), (r"\d{4}", "[）)]"))
    return F.regexp_replace(c, "(?U)(?:" + "|".join(f"(?<={a})\\s+(?={b})" for a, b in pairs) + ")", "")


def dates_to_arabic(c: Column) -> Column:
    """The first year, month and day in Chinese numerals as digits, each on its own."""
    for pattern, unit in (("二[〇○][一二三四五六七八九十〇]{2}", "年"), ("[一二三四五六七八九十〇]{1,2}", "月"), ("[一二三四五六七八九十〇]{1,3}", "日")):
        found = F.regexp_extract(c, f"({pattern}){unit}", 1)
        number = T.numeral(found)
        c = F.when((found != "") & number.isNotNull(), F.replace(c, F.concat(found, F.lit(unit)), F.concat(number.cast("string"), F.lit(unit)))).otherwise(c)
    return c


def date_text(c: Column) -> Column:
    """A date for a report: '' for none."""
    return F.coalesce(dates_to_arabic(c), c, F.lit(""))


def normal_date(c: Column) -> Column:
    return T.strip(F.translate(c, "○零", "〇〇"))


def court_key(c: Column) -> Column:
    return F.translate(T.strip(c), "()[] ", "（）（）")


def district(c: Column, variants_first: bool = True) -> Column:
    """A known district: by a variant, itself, or the first that shares 70 % of the characters in order.

    For names of two characters that share is reached by both of them, in order, in a name of three at most.
    """
    near = F.coalesce(*[F.when((F.length(c) <= 3) & c.rlike(f"{d[0]}.*{d[1]}"), d) for d in T.DISTRICTS])
    variant = F.coalesce(*[F.when(c == wrong, right) for wrong, right in T.DISTRICT_VARIANTS])
    exact = F.when(c.isin(*T.DISTRICTS), c)
    return F.coalesce(variant, exact, near) if variants_first else F.coalesce(near, exact, variant)


def party_name(c: Column) -> Column:
    """A party without the address, code or office that follows it."""
    for label in PARTY_LABELS:
        c = F.substring_index(c, label, 1)
    return T.strip(c)


def company_name(c: Column) -> Column:
    """The longest company name of a text, the first of two, four characters or more; null without one."""
    found = F.flatten(F.array(*[_all(c, f"({_NAME}+?{word})") for word in COMPANY_WORDS]))
    clean = F.transform(found, lambda x: F.regexp_replace(T.strip(F.regexp_replace(x, "^(?:甲方|乙方|名称|申请执行人|被执行人)[:：]?", "")), "[，。；].*$", ""))
    ranked = F.transform(F.filter(clean, lambda x: F.length(x) >= 4), lambda x, i: F.struct(-F.length(x), i, x.alias("name")))
    return F.get(F.sort_array(ranked), 0)["name"]


def company_after(c: Column, labels: Sequence[str]) -> Column:
    """The company after the first label that has one."""
    return F.coalesce(*[company_name(T.strip(F.regexp_extract(c, f"{label}[:：]\\s*([^\\n，。]*)", 1))) for label in labels])


def company_candidates(c: Column) -> Column:
    """Companies after their labels, each once, by the order of labels."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*[_all(c, p) for p in CANDIDATES])), T.strip), lambda x: x != ""))


def first_company(c: Column) -> Column:
    return F.coalesce(*[_first(c, p) for p in FIRST_COMPANY])


def target_company(c: Column, fallback: Column | None = None) -> Column:
    """The company that an application is about; else the fallback, the text's longest company name."""
    joined = F.replace(c, F.lit("\n"), F.lit(""))
    name = F.coalesce(_first(joined, "与(.+?)(?:关于|强制执行)"), _first(joined, "与(.+?)关于.*?(?:执行|审查|一案)"))
    name = T.strip(F.regexp_replace(name, "^(?:委托人|申请人|被执行人|申请执行人)[:：]?", ""))
    return F.coalesce(F.when(F.length(name) >= 4, name), company_name(c) if fallback is None else fallback)


def target_key(c: Column) -> Column:
    """The company of an output file's name, as companies compare."""
    return T.company_key(F.regexp_replace(c, r"\.[^.]*$", ""))


def document_type(c: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(t)), t) for t in DOCUMENT_TYPES])


def page_profile(c: Column) -> Column:
    """struct of what kinds of page of a notice a text is."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    has = lambda w: F.contains(c, F.lit(w))
    return F.struct(
        has("责令限期办理决定书").alias("is_notice_main_page"),
        (has("撤销") & has("责令限期办理决定书")).alias("is_notice_revoke_page"),
        has("送达回证").alias("is_notice_delivery_page"),
        _contains_any(c, ("中国邮政速递物流", "邮件号", "EMS")).alias("is_notice_logistics_page"),
    )


def ruling_fields(c: Column) -> Column:
    arabic = [F.regexp_extract(c, r"(20\d{2})年(\d{1,2})月(\d{1,2})日", i).try_cast("int").cast("string") for i in (1, 2, 3)]
    return F.struct(
        F.when(F.contains(c, F.lit("行政裁定书")), "行政裁定书").alias("document_type"),
        _first(c, r"（\d{4}）粤\d+行审\d+号", 0).alias("administrative_case_no"),
        decision_numbers(c).alias("decision_numbers"),
        _first(c, r"审判员\s*([一-龥]{2,4})").alias("judge"),
        _first(c, r"书记员\s*([一-龥]{2,4})").alias("clerk"),
        F.coalesce(T.chinese_date(c), F.concat(arabic[0], F.lit("年"), arabic[1], F.lit("月"), arabic[2], F.lit("日"))).alias("execution_date"),
    )


def notice_fields(c: Column) -> Column:
    candidates = company_candidates(c)
    return F.struct(
        document_type(c).alias("document_type"),
        F.coalesce(company_after(c, ("名称", "委托单位", "委托人")), F.get(candidates, 0)).alias("company_name"),
        candidates.alias("company_name_candidates"),
        decision_numbers(c).alias("decision_numbers"),
        page_profile(c).alias("page_profile"),
    )


def contract_fields(c: Column) -> Column:
    return F.struct(
        F.when(_contains_any(c, ("合同", "协议")), "合同").alias("document_type"), company_after(c, ("甲方",)).alias("party_a"), company_after(c, ("乙方",)).alias("party_b")
    )


def structured(c: Column) -> Column:
    return F.struct(decision_numbers(c).alias("decision_numbers"), ruling_fields(c).alias("ruling"), notice_fields(c).alias("notice"), contract_fields(c).alias("contract"))


def processed(c: Column) -> Column:
    """The whole clean-up: brackets, white space, usual errors, case numbers, companies. struct<text, case_numbers>."""
    numbered = case_numbers(common_errors(T.tidy(T.ascii_brackets(c))))
    return F.struct(company_spacing(numbered["text"]).alias("text"), numbered["found"].alias("case_numbers"))


def strict_notice(c: Column) -> Column:
    """struct<region, year, number, root, normalized> of the first strict identifier, the region corrected; null without one."""
    part = lambda i: F.regexp_extract(c, STRICT, i)
    region = F.coalesce(*[F.when(part(2) == wrong, right) for wrong, right in REGION_CORRECTIONS], part(2))
    normal = F.concat(part(1), region, F.lit("责字〔"), part(4), F.lit("〕"), part(5), F.lit("号"))
    return F.when(c.rlike(STRICT), F.struct(region.alias("region"), part(4).alias("year"), part(5).alias("number"), F.substring_index(part(5), "-", 1).alias("root"), normal.alias("normalized")))


def strict_notices(c: Column) -> Column:
    return F.transform(_all(c, STRICT, 0), strict_notice)


def distinct_ids(ids: Column) -> Column:
    """Identifiers that are different when compared, the first writing of each."""
    keyed = F.transform(ids, lambda x, i: F.struct(T.notice_key(x).alias("k"), i.alias("i"), x.alias("x")))
    first = lambda xs: F.filter(xs, lambda a: ~F.exists(xs, lambda b: (b["k"] == a["k"]) & (b["i"] < a["i"])))
    return F.transform(F.transform(F.array(keyed), first)[0], lambda a: a["x"])


def relaxed_ids(c: Column) -> Column:
    """Identifiers that reading errors have changed, repaired."""
    return distinct_ids(F.transform(_all(c, RELAXED, 0), T.repair_notice))


def valid_notice(c: Column) -> Column:
    return F.coalesce(F.length(c).between(15, 50) & F.contains(c, F.lit("穗公积金中心")) & F.contains(c, F.lit("责字")) & c.rlike(r"[〔\[(［【（]\d{4}[〕\)\]］】）]"), F.lit(False))


def valid_company(c: Column) -> Column:
    return F.coalesce(F.length(c).between(4, 50) & _contains_any(c, ("集团", "公司", "厂", "店")) & ~c.rlike(r"[\n\r\t ]"), F.lit(False))


def valid_title(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("强制执行申请书")) & _contains_any(c, ("申请人", "被申请人", "执行")), F.lit(False))


def boundary(title: Column, respondent: Column, text: Column) -> Column:
    """struct<boundary, evidence>: a page that begins an application, by its title, its parties or the whole text."""
    twice = lambda x: F.concat(x, T.correct(x, T.CORRECTIONS))
    by_title, by_party = _contains_any(twice(title), BOUNDARY_WORDS), T.hits(twice(respondent), BOUNDARY_EVIDENCE) >= 2
    evidence = F.when(by_title, "primary").when(by_party, "secondary").when(_contains_any(text, BOUNDARY_WORDS), "combined")
    return F.struct(evidence.isNotNull().alias("boundary"), evidence.alias("evidence"))


def _decision(*cases: tuple[Column, bool, str | None]) -> Column:
    out = None
    for when, fallback, reason in cases:
        value = F.struct(F.lit(fallback).alias("fallback"), F.lit(reason).cast("string").alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def notice_fallback(text: Column, n_ids: Column, least: int = 8) -> Column:
    """struct<fallback, reason>: whether a notice's page must be read as a whole."""
    c = T.compact(F.coalesce(text, F.lit("")))
    signal, short = _contains_any(c, ("责字", "责令", "公积金")), F.length(c) < least
    return _decision(
        (n_ids > 0, False, None), (signal | (short & _contains_any(c, ("穗", "越秀"))), False, "weak_notice_signal_only"), (short, True, "region_text_too_short"),
        (_contains_any(c, ("穗", "越秀", "中心")), False, "weak_location_signal"), (F.lit(True), True, "no_notice_signal"),
    )


def application_fallback(candidate: Column, title: Column, respondent: Column, text: Column, gap: Column, neighbour: Column, least: int = 5) -> Column:
    """The same of an application's page. candidate: a case should begin here; gap: boundaries are missing; neighbour: one is next to it."""
    twice = lambda x: F.concat(x, T.correct(x, T.CORRECTIONS))
    titled = F.when(F.coalesce(title, F.lit("")) != "", _contains_any(twice(title), BOUNDARY_WORDS)).otherwise(_contains_any(text, BOUNDARY_WORDS))
    return _decision(
        (~candidate | titled, False, None), (F.coalesce(T.hits(twice(respondent), BOUNDARY_EVIDENCE) >= 2, F.lit(False)), False, "secondary_evidence_found"),
        (F.length(T.compact(text)) < least, True, "boundary_candidate_text_short"), (gap & ~neighbour, True, "boundary_gap_without_neighbor_signal"), (F.lit(True), False, None),
    )


def company_fallback(text: Column, usable: Column, marked: Column, least: int = 6) -> Column:
    short = F.length(T.compact(text)) < least
    return _decision((marked | usable, False, None), (short, True, "region_text_too_short"), (F.lit(True), False, "marker_missing_and_region_unusable"))


def region_usable(text: Column, first_length: Column, words: Sequence[str], fragments: Sequence[str], least_fragments: int = 2, least: int = 6) -> Column:
    """A region's text will do: a keyword, enough fragments of one, or enough characters."""
    c = T.compact(text)
    return _contains_any(c, words) | (T.hits(c, fragments) >= least_fragments) | F.coalesce(first_length >= least, F.lit(False)) | (F.length(c) >= least)


def region_text(attempts: Column, region: str) -> Column:
    """The text of a region's first attempt in array<struct<region, text, ...>>, '' without one."""
    return F.coalesce(F.get(F.filter(attempts, lambda x: x["region"] == region), 0)["text"], F.lit(""))


def region_stats(attempts: Column) -> Column:
    """struct of attempts, seconds, and the longest and whole text of array<struct<region, text_length, duration>>."""
    total = lambda f: F.aggregate(attempts, F.lit(0.0), lambda acc, x: acc + x[f])
    return F.struct(
        F.size(attempts).alias("attempt_count"), F.round(total("duration"), 4).alias("total_duration"),
        F.coalesce(F.array_max(F.transform(attempts, lambda x: x["text_length"])), F.lit(0)).alias("max_text_length"),
        total("text_length").cast("long").alias("total_text_length"), F.transform(attempts, lambda x: x["region"]).alias("regions"),
    )


def current_name(name: Column, history: Column) -> Column:
    return F.when((history != "") & (history != name), F.concat(name, F.lit("（曾用名："), history, F.lit("）"))).otherwise(name)


def location(data: Column) -> Column:
    """A company's address out of a map: the first address of over four characters, else province, city and district; a short one gives way to the longest address-like value."""
    get = lambda k: F.coalesce(F.try_element_at(data, F.lit(k)), F.lit(""))
    full = F.coalesce(*[F.when(F.length(get(k)) > 4, T.strip(get(k))) for k in ADDRESS_KEYS])
    part = lambda *keys: F.coalesce(*[_some(get(k)) for k in keys], F.lit(""))
    found = F.coalesce(full, F.concat(part("Province", "province"), part("City", "city"), part("District", "Area", "district")))
    like = F.map_values(F.map_filter(data, lambda k, v: _contains_any(k, ADDRESS_WORDS) & (v != "")))
    longest = F.get(F.sort_array(F.transform(like, lambda v: F.struct(-F.length(v), v.alias("v")))), 0)["v"]
    return F.when((F.length(found) <= 6) & (F.length(longest) > F.length(found)), longest).otherwise(found)


def task_number(c: Column) -> Column:
    """A task's number at the end of its id; the id itself without one."""
    return F.coalesce(_first(c, r"-(\d+)$"), c)


def all_hits(c: Column, wanted: Sequence[rules.Rule]) -> Column:
    """array<struct<rank, ord, at, value, confidence, source>>: every match of every rule, the surest first, else in order."""

    def hits(i: int, rule: rules.Rule) -> Column:
        sure = lambda x: F.lit(float(rule.weight)) * rules.quality(x)
        each = lambda x, at: F.struct((-sure(x)).alias("rank"), F.lit(i).alias("ord"), at.alias("at"), x.alias("value"), sure(x).alias("confidence"), F.lit(rule.name).alias("source"))
        return F.transform(_all(c, rule.pattern, rule.group), each)

    return F.sort_array(F.flatten(F.array(*[hits(i, rule) for i, rule in enumerate(wanted)])))
