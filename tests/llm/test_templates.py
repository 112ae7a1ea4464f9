import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkrecon.llm import registry, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least, depth=2, fixed=0.7, long_words=None, variable=False, hollow=None):
    shape = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    leaf = lambda s: (len(s), s[:depth])
    texts = {t for _, t in rows}
    docs, leaves = defaultdict(set), defaultdict(set)
    for t in texts:
        for line in (t or "").split("\n"):
            if s := shape(line):
                docs[s].add(t)
                leaves[leaf(s)].add(t)
    held = Counter()
    for s, d in docs.items():
        if len(leaves[leaf(s)]) > least:
            for at, w in enumerate(s):
                held[leaf(s), at, w] += len(d)
    template, of = {}, defaultdict(set)
    for s, d in docs.items():
        parts = tuple((at, w) for at, w in enumerate(s) if w != "<*>" and held[leaf(s), at, w] > least)
        plain = sum(w != "<*>" for w in s)
        enough = len(parts) >= fixed * len(s)
        if variable:
            enough = enough or (len(parts) >= 2 and len(parts) >= fixed * plain) or (len(parts) >= 8 and len(parts) >= 0.5 * len(s))
        if parts and enough:
            template[s] = (leaf(s), parts)
            of[template[s]] |= d
    goes = {s: (t, False) for s, t in template.items() if len(of[t]) > least}
    if long_words:
        goes |= {s: (s, True) for s, d in docs.items() if len(s) >= long_words and len(d) > 1 and s not in goes}
    stays = set()
    if hollow is not None:
        first = {}
        for i, t in rows:
            if i is not None:
                first[t] = min(i, first.get(t, i))
        holders = defaultdict(set)
        for t in texts:
            lines = [x for x in (t or "").split("\n") if shape(x)]
            all_words, left = sum(len(shape(x)) for x in lines), sum(len(shape(x)) for x in lines if shape(x) not in goes)
            for x in lines:
                if shape(x) in goes and (goes[shape(x)][1] or left < (1 - hollow) * all_words):
                    holders[goes[shape(x)][0]].add(t)
        stays = {(name, min(ts, key=lambda t: (first.get(t) is None, first.get(t) or 0))) for name, ts in holders.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if not (s := shape(x)) or s not in goes or (goes[s][0], t) in stays]
        worded = sum(1 for x in lines if WORD.search(x))
        out.append((i, "\n".join(rest) if len(rest) < len(lines) else t, worded, worded - sum(1 for x in rest if WORD.search(x))))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shape", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("_own", F.lit(2))
    got = templates.drop_templates(docs, **more)
    assert got.columns == ["doc_id", "text", "shape", "_own", "n_lines", "n_dropped"]
    got = sorted(map(tuple, got.drop("shape", "_own").collect()), key=repr)
    assert got == brute(rows, **more)
    return got


def test_templates_with_variable_fields(spark):
    rows = [(i, f"the user {name} logged in from {i}.{i}.0.1 at port {i} today\n{' '.join([name] * 40)}") for i, name in enumerate(["ann", "bob", "cy", "dan", "eve", "fay"])]
    rows += [(7, None), (8, ""), (9, " \n\n"), (None, rows[0][1]), (10, rows[0][1]), (11, "the user gil logged in from 1 at port 2 today")]
    got = check(spark, rows, least=3)
    assert sum(r[3] for r in got) == 9  # seven documents, one of them three times; the last is all template
    assert (11, "", 1, 1) in got
    check(spark, [], least=3)
    check(spark, [(1, "x" * 50000 + " 1" + "y" * 50000 + "\n" + "a " * 40000)] * 2, least=0)


def test_documents(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = check(spark, rows, least=3)
    assert any(r[3] for r in got)
    assert registry.op4_line_templates(spark, sf).count() == len(rows)
