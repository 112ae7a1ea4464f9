"""Similarity joins, ladders, stateful tasks, assignments and output names, on small cases against brute force."""

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sparkrecon.operators import exports, matching, outputs, patterns, rungs, similar
from sparkrecon.streaming import tasks

HEAD = "穗公积金中心"


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def varied(rng, letters, lengths, n):
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))) for _ in range(n)]
    for name in list(names):
        s = list(name)
        for _ in range(rng.randrange(1, 2 + len(s) // 6)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.7 else ""
        names.append("".join(s))
    return names


def test_ratio_pairs_and_nearest_leave_none_out(spark):
    rng = random.Random(5)
    for letters, lengths, most in (("甲乙丙丁戊己庚辛壬癸", (1, 12), 10), ("ab", (1, 9), None)):
        names = varied(rng, letters, lengths, 50)
        some = {x for x in names if x}
        df = spark.createDataFrame([(x,) for x in [*names, "", None]], "a string")
        other = df.withColumnRenamed("a", "b")
        for least in (0.6, 0.85):
            want = {(a, b) for a, b in itertools.product(some, some) if SequenceMatcher(None, a, b).ratio() >= least}
            assert {(r.a, r.b) for r in similar.ratio_pairs(df, "a", other, "b", least).collect()} == want
            if most and least > 0.8:
                assert similar.candidates(df, "a", other, "b", least).count() <= most * len(want)
        if letters == "ab":
            continue
        best = {r.a: r.ratio for r in similar.best_pairs(df, "a", other.filter("b > 'b' or b > '丙'"), "b", 0.8).groupBy("a").agg(F.max("ratio").alias("ratio")).collect()}
        theirs = {x for x in some if x > "b" or x > "丙"}
        ratios = {a: max((SequenceMatcher(None, a, b).ratio() for b in theirs), default=0) for a in some}
        assert best == {a: r for a, r in ratios.items() if r >= 0.8}
        found = {r.probe: (r.distance, r.found) for r in similar.nearest(df, "a", other, "b").collect()}
        assert found == {a: min((edits(a, b), b) for b in some if b != a) for a in some}


def test_ratio_pairs_within_blocks(spark):
    left = spark.createDataFrame([("x", "12345678"), ("y", "12345678"), (None, "12345678")], "r string, a string")
    right = spark.createDataFrame([("x", "12345679"), ("z", "12345678")], "q string, b string")
    assert [tuple(r) for r in similar.ratio_pairs(left, "a", right, "b", 0.8, ("r", "q")).collect()] == [("x", "12345678", "12345679", 0.875)]


def test_two_million_rows_are_numbered_once_each(spark):
    rows = spark.range(0, 2_000_000, 1, 16).withColumn("key", F.xxhash64("id"))
    got = outputs.numbered(rows, [F.col("key")], "n")
    assert got.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first() == (2_000_000, 1, 2_000_000)
    assert got.join(got.select((F.col("n") + 1).alias("n"), F.col("key").alias("before")), "n").filter("before >= key").isEmpty()


def test_words_in_texts_over_several_rounds(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(60)] + ["", None]
    texts = [(i, "".join(rng.choices("abéc", k=rng.randint(0, 12)))) for i in range(80)] + [(99, None)]
    want = {(i, w) for i, t in texts if t for w in words if w and w in t}
    table, held = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(w,) for w in words], "w string")
    for size in (patterns.ROUND_BYTES, 40):
        monkeypatch.setattr(patterns, "ROUND_BYTES", size)
        rows = [tuple(r) for r in patterns.contained(table, "id", "t", held, "w").collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert patterns.contained(table, "id", "t", held.limit(0), "w").count() == 0


def walk(pairs):
    used_p, used_t, out = set(), set(), set()
    for _, p, t in sorted(pairs):
        if p not in used_p and t not in used_t:
            out.add((p, t))
            used_p.add(p)
            used_t.add(t)
    return out


def test_assignment_in_rounds_is_the_greedy_walk(spark):
    rng = random.Random(3)
    pairs = [(g, rng.randrange(9), rng.randrange(12), rng.randrange(12)) for g in range(3) for _ in range(rng.randrange(90))] + [(0, 1, None, 3)]
    chain = [(7, i, i // 2, (i + 1) // 2) for i in range(10)]
    table = spark.createDataFrame([*pairs, *chain], "g int, o int, p int, t int")
    want = {(g, *x) for g in range(8) for x in walk({(o, p, t) for k, o, p, t in [*pairs, *chain] if k == g and p is not None})}
    for small in (10_000, 10):
        rows = matching.assign_one_to_one(table, "g", "p", "t", [F.col("o")], small).collect()
        assert {(r.g, r.p, r.t) for r in rows} == want and len(rows) == len(want)


def numbered_names(names, taken):
    held, out = set(taken), []
    for name in names:
        stem, ending = name.rsplit(".", 1) if "." in name else (name, "")
        asked, n = name, 0
        while asked in held:
            n += 1
            asked = f"{stem}-{n}" + (f".{ending}" if ending else "")
        held.add(asked)
        out.append(asked)
    return out


def test_names_never_clash(spark):
    rng = random.Random(4)
    names = [rng.choice(["a.pdf", "a-1.pdf", "a-1-1.pdf", "b.pdf", "a-2.pdf", "c", "c-1"]) for _ in range(60)]
    taken = ["b-2.pdf", "a-3.pdf", "c-1"]
    table = spark.createDataFrame([*enumerate(names)], "i int, name string")
    got = exports.unique_names(table, "name", [F.col("i")], spark.createDataFrame([(x,) for x in taken], "x string")).orderBy("i").collect()
    assert [r.name for r in got] == numbered_names(names, taken)
    assert exports.unique_names(table.limit(0), "name", [F.col("i")]).count() == 0


def test_notices_that_are_alike_or_unknown_are_named(spark):
    cases = spark.createDataFrame([(1, "1-1", f"{HEAD}天河责字〔2024〕1971号"), (2, "1-2", f"{HEAD}番禺责字（2024）3360-1号"), (3, "9", f"{HEAD}天河责字〔2024〕1971号")], "row_no int, sequence string, notice_number string")
    sources = [("a.pdf", f"{HEAD}天河责字〔2024〕1971号", None), ("b.pdf", f"{HEAD}天河责字〔2024〕1971-2号", None), ("c.pdf", f"{HEAD}番禺责字〔2024〕3360-2号", f"{HEAD}番禺责字〔2024〕3360号"), ("d.pdf", "x/y", None), ("e.pdf", f"{HEAD}天河责字〔2024〕1971号", None)]
    got = {r.source: r for r in exports.notice_exports(spark.createDataFrame(sources, "source string, detected string, selected string"), cases).collect()}
    assert got["a.pdf"].name == f"9-责催-{HEAD}天河责字〔2024〕1971号.pdf" and got["e.pdf"].name == f"9-责催-{HEAD}天河责字〔2024〕1971号-1.pdf"
    assert got["b.pdf"].same_root_remap and got["b.pdf"].name == f"9-责催-{HEAD}天河责字〔2024〕1971号[实际{HEAD}天河责字〔2024〕1971-2号].pdf"
    assert got["c.pdf"].match_type == "fuzzy" and got["c.pdf"].name.endswith(f"[实际{HEAD}番禺责字〔2024〕3360号].pdf")
    assert (got["d.pdf"].folder, got["d.pdf"].name) == ("需人工核查", "d_识别到[x_y]_需人工核查.pdf")


def test_costly_rungs_are_called_for_open_pages_only(spark, tmp_path):
    """Every call leaves a line: the pages read from images are those that no earlier rung, and no earlier page, has settled."""
    log = str(tmp_path / "calls")

    @F.udf("struct<text: string, error: string>")
    def read(kind, file, page, text):
        with open(log, "a") as out:
            out.write(f"{kind} {file} {page}\n")
        return (None, "broken") if text == "!" else (text, None)

    notice = f"{HEAD}天河责字〔2024〕1971号"
    pages = [
        ("a", 1, "", "", ""), ("a", 2, notice, "", ""), ("b", 1, "责字", "", notice), ("b", 2, "", notice, ""), ("b", 3, "", notice, ""), ("c", 1, "", "", ""), ("c", 2, "", "!", "!"), ("c", 3, "", "", notice), ("d", 1, "", "", ""), ("d", 4, notice, notice, notice),
        (None, 1, notice, "", ""),
    ]
    table = spark.createDataFrame(pages, "file string, page int, layer string, header string, whole string")
    image = lambda kind: read(F.lit(kind), "file", "page", kind)
    got = {r.file: tuple(r)[1:] for r in rungs.notice_ladder(table, "file", "page", F.col("layer"), image("header"), image("whole")).collect()}
    assert got["a"] == (True, notice, "pdfplumber", 2, None, False, None)
    assert got["b"] == (True, notice, "region_ocr", 2, "notice_header", False, None)
    assert got["c"] == (False, None, "full_page_ocr", None, None, True, "broken")
    assert got["d"] == (False, None, "full_page_ocr", None, None, True, "未找到责令号") and len(got) == 4
    calls = Counter(open(log).read().splitlines())
    assert calls == Counter(["header b 1", "header b 2", "header c 1", "header c 2", "header c 3", "header d 1", "whole c 1", "whole c 2", "whole d 1"])


def test_stream_of_statuses_survives_a_restart(spark, tmp_path):
    spark.conf.set(*tasks.PROVIDER)
    rows = [(f"t{i % 7}", i // 7, i % 5 == 0, f"e{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "task string, seq long, ok boolean, error string")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    broken = [True]

    def run():
        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if broken.pop() if broken else False:
                raise RuntimeError("killed after the write, before the commit")

        stream = tasks.statuses(spark.readStream.schema(table.schema).parquet(source), 2)
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:  # the next run goes on from the checkpoint
            return False
        return True

    table.filter("seq < 4").write.parquet(source)
    assert not run()
    table.filter("seq >= 3").write.mode("append").parquet(source)  # the results of number 3 come twice
    assert run() or run()
    got = sorted(tuple(r) for r in tasks.latest(spark.read.parquet(out)).collect())
    assert got == sorted(tuple(r) for r in tasks.counted(table, 2).collect())


def test_stream_stops_a_file_early(spark, tmp_path):
    spark.conf.set(*tasks.PROVIDER)
    kind = "file string, page int, hit boolean"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        query = tasks.stop_early(spark.readStream.schema(kind).parquet(source)).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        query.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    for part in ([("a", 1, False), ("b", 1, False)], [("a", 2, True), ("a", 3, True), ("b", 2, False)], [("a", 4, False), ("b", 3, True)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {(r.file, r.page): r.status for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): "read", ("a", 2): "hit", ("a", 3): "skipped", ("a", 4): "skipped", ("b", 1): "read", ("b", 2): "read", ("b", 3): "hit"}
