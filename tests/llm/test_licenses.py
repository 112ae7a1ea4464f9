import random
import re

from sparkrecon.llm import licenses, registry


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base(text):
    words = licenses.WORD.findall(lower(text))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_automaton_against_brute_force():
    random.seed(3)
    for _ in range(500):
        sequences = [[random.choice("abc") for _ in range(random.randint(1, 9))] for _ in range(random.randint(1, 4))]
        m = licenses.Automaton(sequences, [True] * len(sequences))
        text = [random.choice("abcd") for _ in range(20)]
        state = size = 0
        for at, w in enumerate(text, 1):
            while state and w not in m.next[state]:
                state = m.link[state]
                size = m.length[state]
            state, size = (m.next[state][w], size + 1) if w in m.next[state] else (0, 0)
            ends = lambda k: sorted((i, j + k) for i, s in enumerate(sequences) for j in range(len(s) - k + 1) if s[j : j + k] == text[at - k : at])  # noqa: B023, E731
            assert size == max((k for k in range(1, at + 1) if ends(k)), default=0)
            if size:
                assert sorted(m.ends[state]) == ends(size)
            assert sorted(i for i in m.whole[state] if len(sequences[i]) <= size) == [i for i, s in enumerate(sequences) if text[max(0, at - len(s)) : at] == s]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op12_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.n_base or not r.labels  # of these tables: a clean document gets no label


def spans(text):
    return licenses.scanner(licenses.TEMPLATES, licenses.PHRASES, 3, 8, 0.8)(lower(text))


def test_spans_of_whole_and_changed_templates():
    random.seed(5)
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            found = licenses.WORD.findall(t.lower())
            d = spans(f"one two {t} three")
            assert any(s["label"] == label and s["first_word"] == 2 and s["last_word"] == 1 + len(found) and s["share"] == 1 for s in d["spans"]), label
            if len(found) > 25:  # a word changed here and there, and filling put in
                changed = [*found]
                for at in range(7, len(changed) - 3, 12):
                    changed[at] = "changed"
                changed[20:20] = ["filling", "filling"]
                d = spans(" ".join(changed))
                assert any(s["label"] == label and s["first_word"] == 0 and s["share"] >= 0.8 for s in d["spans"]), label
            half = spans(" ".join(found[: len(found) // 2]))
            assert not any(s["label"] == label for s in half["spans"] if len(templates) == 1)


def test_chained_coverage_against_brute_force():
    """The words that a chain covers are at most the longest common subsequence of runs, and all of a run that stands alone."""
    random.seed(7)
    template = [f"t{i}" for i in range(30)]
    scan = licenses.scanner({"x": [" ".join(template)]}, {}, 3, 8, 0.5)
    for _ in range(300):
        kept, text = 0, []
        for at in range(0, 30, 5):
            if random.random() < 0.7:
                text += template[at : at + 5]
                kept += 5
            text += ["filler"] * random.randint(0, 3)
        d = scan(" ".join(text))
        gaps = [m for m in re.findall(r"t\d+(?: filler)*", " ".join(text))]
        assert d["n_words"] == len(text) and d["score"] <= kept / 30 + 1e-9
        if kept >= 20 and not re.search("(?:filler ?){9}", " ".join(text)) and len(gaps) == kept:
            missing = [at for at in range(0, 30, 5) if f"t{at}" not in text]
            if not any(b - a == 5 for a, b in zip(missing, missing[1:])):
                assert d["spans"] and d["score"] == kept / 30


def test_odd_rows(spark):
    long = "the of and word " * 150000 + "released under the MIT license " + "x" * 3000000 + " cc by"
    rows = [(1, None), (None, ""), (2, long), (3, "MIT License MIT LICENSE cc-by"), (3, "MIT License MIT LICENSE cc-by"), (4, "ıMIT Lİcense mit license"), (5, "\x00\x7f cc\x00by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS LABELS", "'y' AS _d")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "text", "_d", *licenses.ADDED]
    got = got.collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [base(t) for _, t in rows]
    assert {r["_d"] for r in got} == {"y"} and got[0].labels == "" and got[0].score == 0 and got[3].score == 1
    assert [(s.label, s.first_word, s.last_word) for s in got[2].spans] == [("mit", 600000, 600004)]
    assert licenses.scan(docs.limit(0)).count() == 0
