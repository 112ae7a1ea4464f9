import random
import re
import zlib
from collections import Counter

from sparkrecon.llm import registry, spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_automaton_against_brute_force():
    random.seed(1)
    for letters in ("ab", "abcé") * 300:
        words = sorted({"".join(random.choices(letters, k=random.randint(0, 5))) for _ in range(random.randint(1, 40))})
        shards = [spelling.Descent(spelling.trie(part, [1] * len(part))) for part in (words[: len(words) // 2], words[len(words) // 2 :]) if part]
        before = ""
        for w in [*words, *("".join(random.choices(letters, k=random.randint(0, 6))) for _ in range(5))]:
            common, before = spelling.alike(before, w), w
            found = [s.words[i] for s in shards for i in s.near(w, common)]
            assert sorted(found) == [v for v in words if one_apart(w, v)]


def test_variants_in_many_shards_and_rounds(spark, monkeypatch):
    random.seed(2)
    counts = {"".join(random.choices("abcdé", k=random.randint(1, 5))): random.choice((2, 3, 20, 30, 300, 4000)) for _ in range(900)}
    monkeypatch.setattr(spelling, "ROUND_BYTES", 2000)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 100)  # as many ranges as that
    table = spark.createDataFrame([*counts.items(), (None, 5), ("negative", -1)], "word string, n long").selectExpr("*", "1 AS form", "2 AS _word")
    assert got(spelling.variants(table)) == brute(counts)


def test_chains_ties_and_empty(spark):
    counts = {"aaaaaaa": 5000, "aaaaaab": 300, "aaaaabb": 20, "aaaabbb": 2, "zzzzzzx": 40, "zzzzzzy": 40, "zzzzzzz": 4, "x" * 30000: 50, "x" * 29999: 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = got(spelling.variants(table))
    assert rows == brute(counts)
    assert rows["aaaabbb"][:2] == ("aaaaabb", "aaaaaaa") and rows["zzzzzzz"][0] == "zzzzzzx"
    assert got(spelling.variants(table.limit(0))) == {}


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = counted(docs)
    found = {w: n for w, n in found.items() if n >= 2}
    few = set(random.Random(3).sample(sorted(found), 150))
    rows = got(registry.op11_spelling_variants(spark, sf))
    assert {w: r[2] for w, r in rows.items()} == found
    for w in few:
        near = [v for v in found if one_apart(w, v)]
        best = min(near, key=lambda v: (-found[v], v), default=None)
        assert rows[w][3] == len(near) and rows[w][0] == (best if best and found[best] >= 10 * found[w] else None)


def counted(docs):
    n = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{run}".encode())
            word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= 7:
                n[word] += 1
    return n


def test_words_of_odd_documents(spark):
    rows = [(1, None), (None, "Éclairage éclairage ÉCLAIRAGE"), (2, ""), (3, "short words 12"), (3, "short words 12"), (4, "abcdefg " * 5000), (5, "straße×÷Übergrößen straße×÷Übergrößen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {r.word: r.n for r in spelling.damaged_words(docs.selectExpr("*", "1 AS word", "2 AS n", "3 AS run")).collect()}
    assert words == {w: n for w, n in counted(docs.collect()).items() if n >= 2}
    assert spelling.damaged_words(docs.limit(0)).count() == 0
