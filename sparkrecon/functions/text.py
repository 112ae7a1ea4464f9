"""Text correction and normalisation as Columns: no Python runs on a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brackets, digits, districts, prefixes and company words of the notices.
OPEN, CLOSE = "〔[(［【（", "〕)]］】）"
DIGITS = "〇一二三四五六七八九"
DISTRICTS = ("天河", "海珠", "荔湾", "越秀", "白云", "黄埔", "番禺", "南沙", "萝岗", "花都", "增城", "从化", "开发")
DISTRICT_VARIANTS = (("番禹", "番禺"), ("香禹", "番禺"), ("步禹", "番禺"), ("罗岗", "萝岗"), ("海蛛", "海珠"), ("越矛", "越秀"))
PREFIX = "穗公积金中心"
PREFIX_VARIANTS = ("穗公积金中心", "稳公积金中心", "德公积金中心", "稍公积金中心")
COMPANY_SUFFIXES = (
    "股份有限公司", "有限责任公司", "有限公司", "集团公司", "股份公司", "合伙企业", "分公司", "事务所", "研究院",
    "服务中心", "合作社", "医院", "大学", "学院", "幼儿园", "管理中心", "协会", "中心",
)
CORRECTIONS = (
    ("番禹", "番禺"), ("天何", "天河"), ("白去", "白云"), ("荔弯", "荔湾"), ("海猪", "海珠"), ("越莠", "越秀"),
    ("黄浦", "黄埔"), ("花者", "花都"), ("萝岗", "萝岗"), ("【", "〔"), ("】", "〕"),
)

# An identifier's form; a district never holds a mark of punctuation.
NOTICE_HEAD = r"穗公积金中心[^\s，。；、《》]*?责字[〔\[(［【（]\d{4}[〕\)\]］】）]"
NOTICE = NOTICE_HEAD + r"\d+(?:-\d+)?号"
NOTICE_RANGE = rf"({NOTICE_HEAD})(\d+)号至\s*(\d+)号"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def safe_cell(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def correct(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacement: each rule sees what the rules before it made."""
    for wrong, right in rules:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def merge_rules(*layers: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Earlier layers shadow later ones by what they replace; order is kept."""
    merged: dict[str, str] = {}
    for layer in layers:
        for wrong, right in layer:
            merged.setdefault(wrong, right)
    return list(merged.items())


def correct_once(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A rule acts only if what it makes does not stand before the first place it would act on."""
    for wrong, right in rules:
        before = F.substring_index(c, wrong, 1)
        c = F.when(F.contains(c, F.lit(wrong)) & ~F.contains(before, F.lit(right)), F.replace(c, F.lit(wrong), F.lit(right))).otherwise(c)
    return c


def ascii_brackets(c: Column) -> Column:
    return F.translate(c, "（）【】〔〕［］", "()[][][]")


def notice_key(c: Column) -> Column:
    """Notice identifiers compare without spaces and with one kind of bracket; null and blank are ''."""
    return F.translate(F.coalesce(strip(c), F.lit("")), "()（）[]【】［］ ", "〔〕〔〕〔〕〔〕〔〕")


def notice_root(c: Column) -> Column:
    """The base number: without its sub-number."""
    return F.regexp_replace(c, r"(\d+)-\d+号$", "$1号")


def company_key(c: Column) -> Column:
    return F.translate(F.coalesce(strip(c), F.lit("")), "（）\n\r ", "()")


def respondent_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s　]+", "")


def company_core(c: Column, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    """The name without the first suffix of the list that it ends with."""
    core = c
    for suffix in reversed(suffixes):
        core = F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(core)
    return core


def suffixes_in(c: Column, suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    return F.filter(F.array(*map(F.lit, suffixes)), lambda s: F.contains(c, s))


def same_branch(a: Column, b: Column, word: str = "分公司") -> Column:
    return F.contains(a, F.lit(word)) == F.contains(b, F.lit(word))


def tidy(c: Column) -> Column:
    """At most one blank line, one space for a run of blanks, no white space at the ends of a line."""
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}", " ")
    return F.array_join(F.transform(F.split(c, "\n"), strip), "\n")


def compact(c: Column) -> Column:
    return F.translate(c, "\n ", "")


def halfwidth(c: Column) -> Column:
    """Full-width letters and digits as ASCII."""
    wide = [chr(ord(x) + 0xFEE0) for x in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    return F.translate(c, "".join(wide), "".join(chr(ord(x) - 0xFEE0) for x in wide))


def join_cjk(c: Column) -> Column:
    """Without white space between two characters of the Chinese block."""
    return F.regexp_replace(c, r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])", "")


def repair_notice(c: Column) -> Column:
    """The usual prefix for a misread one, 责 for 贵, districts by their variants."""
    c = F.regexp_replace(c, "^(?:" + "|".join(PREFIX_VARIANTS) + ")", PREFIX)
    return correct(F.replace(c, F.lit("贵字"), F.lit("责字")), DISTRICT_VARIANTS)


def notice_parts(c: Column) -> Column:
    """struct<prefix, district, year, number> of a notice; null where it is none."""
    pattern = r"^([一-鿿]{1,2}公积金中心)([一-鿿]{0,4}?)[责贵]字[〔\[(［【（](\d{4})[〕\)\]］】）](\d+(?:-\d+)?)号"
    part = lambda i: F.regexp_extract(c, pattern, i)
    names = ("prefix", "district", "year", "number")
    return F.when(c.rlike(pattern), F.struct(*[part(i + 1).alias(n) for i, n in enumerate(names)]))


def district(c: Column) -> Column:
    """A known district, itself or by a variant; else null."""
    fixed = correct(c, DISTRICT_VARIANTS)
    return F.when(fixed.isin(*DISTRICTS), fixed)


def expand_ranges(starts: Column, ends: Column, most: int | None = 20) -> Column:
    """Whole numbers from start to end; none for a falling range, nor for one longer than most."""
    fine = ends >= starts
    if most is not None:
        fine = fine & (ends - starts <= most)
    return F.when(fine, F.sequence(starts, ends)).otherwise(F.array().cast("array<bigint>"))


def notices(c: Column, pattern: str = NOTICE, ranged: str = NOTICE_RANGE) -> Column:
    """All notice identifiers of a text: those of ranges first, then single ones, each once."""
    heads, low, high = (F.regexp_extract_all(c, F.lit(ranged), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(heads.alias("head"), low.alias("low"), high.alias("high"))
    many = F.flatten(
        F.transform(
            zipped,
            lambda z: F.transform(expand_ranges(z["low"].cast("long"), z["high"].cast("long")), lambda n: F.concat(z["head"], n.cast("string"), F.lit("号"))),
        )
    )
    return F.array_distinct(F.concat(many, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))


def without_short_forms(ids: Column) -> Column:
    """Without identifiers that another, longer one ends with."""
    return F.filter(ids, lambda x: ~F.exists(ids, lambda y: F.endswith(y, x) & (F.length(y) > F.length(x))))


def numeral(c: Column) -> Column:
    """A Chinese numeral below 1,000 as a number: digits by place, or with 十 and 百; null for anything else."""
    c = F.translate(c, "零○", "〇〇")
    places = F.translate(c, DIGITS, "0123456789").try_cast("int")
    hundreds = F.regexp_extract(c, "^([一二三四五六七八九])百", 1)
    tens = F.regexp_extract(c, "([一二三四五六七八九]?)十", 1)
    ones = F.regexp_extract(c, "([一二三四五六七八九])$", 1)
    value = lambda x: F.coalesce(F.translate(x, DIGITS, "0123456789").try_cast("int"), F.lit(0))
    total = value(hundreds) * 100 + F.when(F.contains(c, F.lit("十")), F.greatest(value(tens), F.lit(1)) * 10).otherwise(0) + value(ones)
    counted = c.rlike("^(?:[一二三四五六七八九]百〇?)?(?:[一二三四五六七八九]?十)?[一二三四五六七八九]?$") & c.rlike("[十百]")
    return F.when(c.rlike(f"^[{DIGITS}]+$"), places).when(counted, total)


def chinese_date(c: Column) -> Column:
    """The first date in Chinese numerals as Y年M月D日; null without one."""
    pattern = rf"([{DIGITS}零○]{{4}})年([{DIGITS}十]{{1,3}})月([{DIGITS}十]{{1,3}})日"
    year, month, day = (numeral(F.regexp_extract(c, pattern, i)).cast("string") for i in (1, 2, 3))
    return F.when(c.rlike(pattern), F.concat(year, F.lit("年"), month, F.lit("月"), day, F.lit("日")))


def amount(c: Column) -> Column:
    """An amount of money with separators; null where it is none."""
    return F.translate(c, ",， ", "").try_cast("double")


def amount_text(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def person(c: Column) -> Column:
    """A name without the numerals that trail it; one character at least stays."""
    return F.regexp_replace(F.regexp_replace(c, "(?<=.)[二〇○零一三四五六七八九十—本]+$", ""), r"\d+$", "")


def hits(c: Column, words: Sequence[str]) -> Column:
    """How many of the words a text contains."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def natural_key(c: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def column_number(c: Column) -> Column:
    """A spreadsheet column's letters as its number from 1."""
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
