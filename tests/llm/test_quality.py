import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkrecon.llm import quality, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def brute(rows, least, min_words=10):
    """rows: (id, source, text)."""
    seen, out = defaultdict(set), []
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                seen[source, normal(line)].add(text)
    for i, source, text in rows:
        t = text or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        spans = defaultdict(list)
        for k in range(len(words) - 4):
            spans[tuple(words[k : k + 5])].append(k)
        covered = {p + j for ps in spans.values() if len(ps) > 1 for p in ps for j in range(5)}
        lost = sum(len(WORD.findall(x)) for x in lines if len(seen[source, normal(x)]) > least)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), lost, failed, not failed and not (lost and len(words) - lost < min_words)))
    return sorted(out, key=repr)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept"]


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_n", F.lit(1)).withColumn("_keys", F.lit("x"))
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("_own_body", F.lit(3)).withColumn("KEPT", F.lit(3))
    got = quality.rules(docs, least=least)
    assert got.columns == ["doc_id", "source", "text", "_n", "_keys", "_own_body", *COLUMNS]
    assert not rows or tuple(got.select("_n", "_keys", "_own_body").distinct().first()) == (1, "x", 3)
    got = sorted(map(tuple, got.select("doc_id", *COLUMNS).collect()), key=repr)
    assert got == brute(rows, least)


def test_rules_on_documents(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()))
    check(spark, rows, 2)


def test_odd_rows(spark):
    line = "one two three four five six\t seven eight nine ten eleven"
    rows = [(i, "a", f"{line}\n{'x' * i}") for i in range(6)]
    rows += [(9, "a", "ONE two three four five six seven  eight nine ten eleven \n\n"), (9, None, line), (None, None, None)]
    rows += [(None, None, None), (20, "a", ""), (21, "b", " \n\t"), (22, "b", "w " * 30000), (23, "b", "# é 中 $% 3"), (None, "a", line)]
    check(spark, rows, 2)
    check(spark, [], 2)


def test_removal_takes_frequent_lines_out(spark):
    rows = [(i, "a", f"the same line\nown line {chr(97 + i) * 3}\n\n") for i in range(5)] + [(9, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in quality.rules(docs, least=2, remove=True).collect()}
    assert got == {i: f"own line {chr(97 + i) * 3}\n\n" for i in range(5)} | {9: None}


def test_query_returns_every_document(spark, sf):
    got = registry.op1_quality_rules(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
