"""Frequent lines that the pipeline removes whatever the host's size."""

import corpus_pipeline


def test_limit_does_not_grow_with_the_host(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i: f"ten words or more of text number x{i}x are here y{i}y".translate(letters)
    line = "home about us contact and imprint of this very host with words"
    rows = [(i, "a", f"{line}\n{own(i)}") for i in range(30)] + [(i, "a", own(i)) for i in range(30, 3500)]
    rows += [(4000, "a", line)]  # all such lines: depleted
    rows += [(5000 + i, "b", f"{line}\n{own(i)}") for i in range(20)]  # not over 20 of its host
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {i: own(i) for i in range(3500)} | {5000 + i: f"{line}\n{own(i)}" for i in range(20)}
