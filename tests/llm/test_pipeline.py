"""Each stage on its own input against brute force, and the chain end to end."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkrecon.llm import scratch

from . import test_mixing, test_quality, test_shingles, test_templates

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(scratch.table(stage(spark, after[-1], sf), re.sub(r"\W", "-", name)))
    assert all(d.columns == columns for d in after[:-1])
    at = [[r.asDict() for r in d.collect()] for d in after]

    kept = {r[0] for r in test_quality.brute([(d["doc_id"], d["source"], d["text"]) for d in at[0]], 20) if r[-1]}
    assert {d["doc_id"] for d in at[1]} == kept

    want = test_templates.brute([(d["doc_id"], d["text"]) for d in at[1]], 20, long_words=50, variable=True, hollow=0.5)
    assert sorted((d["doc_id"], d["text"]) for d in at[2]) == sorted((r[0], r[1]) for r in want)
    assert all(d["n_chars"] == len(d["text"]) for d in at[2])

    want = test_shingles.brute([(d["doc_id"], d["text"]) for d in at[2]], 5, 80, 100)
    assert sorted(d["doc_id"] for d in at[3]) == sorted({r[0] for r in want if r[0] == r[2]})

    size = defaultdict(int)
    for d in at[3]:
        size[d["source"]] += len(WORD.findall(d["text"]))
    targets, taken = test_mixing.targets(size), Counter()
    texts = {d["doc_id"]: " ".join(WORD.findall(d["text"])) for d in at[3]}
    for d in at[4]:
        words = WORD.findall(d["text"])
        taken[d["source"]] += len(words)
        assert words and " ".join(words) in texts[d["doc_id"]]
    assert all(abs(taken[s] - targets[s]) <= 130 for s in size)

    assert sum(r["size"] for r in at[5]) == sum(taken.values())
    assert {r["doc_id"] for r in at[5]} == {d["doc_id"] for d in at[4]}

    # the stages once more, from the start: reruns agree
    assert sorted(map(repr, rows_of(corpus_pipeline.run(spark, sf)))) == sorted(map(repr, rows_of(after[-1])))


CLASHES = ["_own", "_body", "_maybe", "n_lines", "n_words", "passes", "size", "component_id", "root", "fp", "_rank", "position"]


def odd_documents(spark):
    """Null and empty texts, null sources and ids, repeated rows, a long text, and columns with names that the operators use."""
    prose = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, prose(30, "a"), "x"), (1, prose(30, "a"), "x"), (2, prose(30, "a") + " more", "y"), (3, None, "x"), (4, "", None), (5, " \n\t", "x")]
    rows += [(None, prose(40, "b"), None), (None, prose(40, "b"), None), (6, prose(5000, "c"), "z"), (7, prose(20, "d") + "\n" + prose(55, "e"), "x"), (8, prose(20, "f") + "\n" + prose(55, "e"), "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def test_odd_documents(spark, sf):
    docs = odd_documents(spark)
    columns = docs.columns
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        after.append(scratch.table(stage(spark, after[-1], sf), re.sub(r"\W", "-", name)))
    assert all(d.columns == columns for d in after[:-1])
    assert all(tuple(r) == tuple(range(len(CLASHES))) for d in after[:-1] for r in d.select(*CLASHES).distinct().collect())
    ids = [sorted((r.doc_id for r in d.collect()), key=repr) for d in after]
    assert ids[1] == [1, 1, 2, 6, 7, 8, None, None]
    assert ids[2] == ids[1]
    assert ids[3] == [1, 6, 7, 8, None]  # one of a group, a repeated row too
    assert set(ids[4]) == set(ids[5]) and set(ids[4]) <= set(ids[3])
    texts = {r.doc_id: r.text for r in after[2].collect()}
    assert "e3" in texts[7] and "e3" not in texts[8]


def test_empty_table(spark, sf):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
