"""Templates and passages that the pipeline drops whatever the table's size."""

import corpus_pipeline


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def own(i):
    """Seventy words of one document, in lines of seven."""
    return "\n".join(" ".join(f"w{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + j)}" for j in range(7)) for k in range(10))


def test_limit_does_not_grow_with_the_table(spark):
    line = "this line is in thirty texts"
    rows = [(i, f"{line}\n{own(i)}") for i in range(30)] + [(i, own(i)) for i in range(30, 7000)]
    got = run(spark, rows)
    assert got == {i: own(i) for i in range(7000)}


def test_long_passage_of_few_texts_stays_once(spark):
    passage = " ".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = [(4, f"{own(4)}\n{passage}"), (2, f"{passage}\n{own(2)}"), (3, f"{own(3)}\n{passage}\n{own(5)}"), (9, f"{own(3)}\n{passage}\n{own(5)}"), (7, None), (8, "")]
    got = run(spark, rows)
    assert got == {2: rows[1][1], 3: f"{own(3)}\n{own(5)}", 4: own(4), 7: None, 8: "", 9: f"{own(3)}\n{own(5)}"}


def test_lines_go_whatever_their_share_of_the_document(spark):
    passage = "\n".join(" ".join(f"p{chr(97 + k)}{chr(97 + i)}" for i in range(10)) for k in range(6))
    rows = [(i, f"{passage}\n{' '.join(own(i).split()[:40])}") for i in range(30)]
    got = run(spark, rows)
    assert got == {0: rows[0][1]} | {i: " ".join(own(i).split()[:40]) for i in range(1, 30)}
    rows = [(i, f"{passage}\n{own(i)}") for i in range(30)]  # boilerplate of all: in none
    assert run(spark, rows) == {i: own(i) for i in range(30)}


def test_templates_of_many_fields(spark):
    rows = [(i, f"Page {i} of {i + 9}\n{own(i)}") for i in range(30)]
    assert run(spark, rows) == {i: own(i) for i in range(30)}
    rows = [(i, f"to all {' '.join('abcdefgh')} {own(i).replace(chr(10), ' ')[:23]}\n{own(i)}") for i in range(30)]
    assert run(spark, rows) == {i: own(i) for i in range(30)}
    rows = [(i, f"in the {' '.join(own(i).split()[:2])}\n{own(i)}") for i in range(30)]  # prose that begins alike
    assert run(spark, rows) == dict(rows)
