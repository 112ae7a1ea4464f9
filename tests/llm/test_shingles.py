import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparkrecon.llm import filters, registry, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, p, q):
    sets = [grams(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for w in where.values() for a in w for b in w if a < b}
    for a, b in pairs:
        if q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, k, p, q, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, shingles.near_duplicates(docs, k, p, q, **more).collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        words[i : i + 1] = [] if kind < 0.3 else [f"new{rng.randrange(10**6)}"] if kind < 0.7 else [words[i], f"ins{rng.randrange(10**6)}"]
    return " ".join(words)


def test_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for c in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        rows += [(len(rows) + i, edited(rng, base, rng.randrange(0, 2 + len(base) // 12))) for i in range(70 if c == 0 else 20)]
    rng.shuffle(rows)
    for k, p, q in ((3, 90, 100), (5, 80, 100)):
        assert run(spark, rows, k, p, q) == brute(rows, k, p, q)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one"), (None, "alone here"), (6, "a b"), (7, "b a"), (7, "b a"), (8, long), (9, long + " y"), (None, None)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert run(spark, [], 3, 90, 100) == []


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (2, text), (2, text), (9, text + " more"), (None, "null ids stay once"), (None, "null ids stay once"), (3, None), (3, None), (4, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")).withColumn("fp", F.lit("y"))
    got = shingles.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(2, text), (None, "null ids stay once"), (3, None), (3, None), (4, "b")], key=repr)


def test_query(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, registry.op8_jaccard_join(spark, sf).collect()), key=repr) == brute(rows, 3, 90, 100)


def test_sets_that_share_rare_tokens_only(spark, monkeypatch):
    passage = lambda i, j: " ".join(f"p{min(i, j)}-{max(i, j)}-{w}" for w in range(30))  # noqa: E731  that two rows have
    rows = [(i, " ".join(passage(i, j) for j in range(13) if j != i)) for i in range(13)]
    near = [(100, rows[0][1] + " end"), (101, rows[1][1] + " end")]
    kept = {}

    def table(df, name, rows=None, write=shingles.scratch.table):
        out = write(df, name, rows)
        if name in ("shared-tokens", "marks"):
            kept[name] = out.filter("t is not null").count() if name == "shared-tokens" else out.count()
        return out

    monkeypatch.setattr(shingles.scratch, "table", table)
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert kept == {"shared-tokens": 0, "marks": 0}
    assert run(spark, rows + near, 3, 90, 100) == brute(rows + near, 3, 90, 100)
    assert kept["marks"] == 4


def test_each_similar_pair_stays_with_its_token():
    rng = np.random.default_rng(6)
    for p, q in ((90, 100), (80, 100), (1, 1)):
        for members, times in ((3, 1), (40, 1), (shingles.MANY, 1), (shingles.MANY + 1, 2)):
            sets = []
            for _ in range(members):
                base = sets[rng.integers(len(sets))] if len(sets) and rng.random() < 0.3 else rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64)
                drop = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.3])
                sets.append(np.unique(np.concatenate([base[~drop], rng.integers(0, 2**64, 1 + drop.sum() // 2, dtype=np.uint64)])))
            sets.sort(key=len)
            tokens = np.repeat(np.arange(times), members)
            stays = shingles._partnered(tokens, np.stack([shingles._sign(s) for s in sets] * times), p, q)
            if members > shingles.MANY:
                assert stays.all()
            for i, a in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(a, sets[j])) if q * len(sets[j]) >= p * len(a) else 0
                    if q * both >= p * (len(a) + len(sets[j]) - both):
                        assert stays[[i, j]].all()
    assert shingles._partnered(np.empty(0), np.empty((0, 5), dtype=np.uint32), 90, 100).tolist() == []


def test_set_of_a_row_flagged_alone(spark):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(20000)], "doc_id long, text string")
    keys = docs.filter("doc_id < 300").select(F.xxhash64("text").alias("key"))
    few = filters.flagged(docs, F.xxhash64("text"), keys, "maybe", 256).filter("maybe")
    assert few.filter("doc_id < 300").count() == 300
    assert few.count() < 300 + 20000 // 128
