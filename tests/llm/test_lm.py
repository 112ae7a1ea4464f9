import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from sparkrecon.llm import lm, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 7


def tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), " end"]


def exact_weights(held, words, rounds=100):
    """Expectation-maximisation on estimates as they are, written apart from the operator."""
    weights = {}
    for bucket in {k[0] for k in held}:
        tokens = [(two, one, 1 / (words + 1), n) for (b, two, one), n in held.items() if b == bucket]
        w = (0.3, 0.6, 0.1)
        for _ in range(rounds):
            total = [0.0, 0.0, 0.0]
            for *p, n in tokens:
                whole = sum(x * y for x, y in zip(w, p))
                total = [t + n * x * y / whole for t, x, y in zip(total, w, p)]
            w = tuple(t / sum(total) for t in total)
        weights[bucket] = [0.999 * x + 0.001 * y for x, y in zip(w, (0.3, 0.6, 0.1))]
    return weights


def brute(rows, exact=False):
    one, two, context = Counter(), Counter(), Counter()
    parts = {"main": (Counter(), Counter(), Counter()), "all": (one, two, context)}
    for i, t in rows:
        if fold(i) != 2:
            for name, (a, b, c) in parts.items():
                if name == "all" or fold(i) != 3:
                    w = tokens(t)
                    a.update(w)
                    b.update(zip([" begin", *w], w))
                    c.update([" begin", *w[:-1]])
    a, b, c = parts["main"]
    n, v = sum(a.values()), len(a)
    held, as_is = Counter(), Counter()
    step = lambda p: -1 if p <= 0 else round(float(np.rint(-2 * math.log2(p))))
    for i, t in rows:
        if fold(i) == 3:
            w = tokens(t)
            for h, x in zip([" begin", *w], w):
                held[c[h].bit_length(), step(b[h, x] / max(1, c[h])), step(a[x] / max(1, n))] += 1
                as_is[c[h].bit_length(), b[h, x] / max(1, c[h]), a[x] / max(1, n)] += 1
    counts = pd.DataFrame([(*k, x) for k, x in held.items()], columns=["bucket", "two", "one", "n"])
    weights = lm.learn_weights(counts, v)
    if exact:
        found = exact_weights(as_is, v)
        weights = {k: found.get(k, list(lm.USUAL)) for k in range(lm.FREQUENCIES)}
        weights[0] = [0.0, *(x / sum(weights[0][1:]) for x in weights[0][1:])]
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip([" begin", *w], w):
            k = weights[context[h].bit_length()]
            score += math.log10(k[0] * two[h, x] / max(1, context[h]) + k[1] * one[x] / max(1, n) + k[2] / (v + 1))
        out.append((i, fold(i) == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted(map(tuple, got), key=repr)
    key = lambda r: (repr(r[0]), r[2], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_query(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = registry.op3_lm_scores(spark, sf).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the half-octave steps that the weights are learned on cost next to nothing
    exact = brute(rows, exact=True)
    assert abs(sum(r[-1] for r in exact) / sum(r.score for r in got) - 1) < 0.002


def test_odd_rows(spark):
    rows = [(i, f"a b c {i % 5} A  b\n") for i in range(60)] + [(7, None), (8, ""), (None, "a b"), (None, None), (9, "z " * 40000), (9, "z " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(lm.score(docs, block_bytes=2000).collect(), brute(rows))
    assert lm.score(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert lm.score(one).count() == 1
