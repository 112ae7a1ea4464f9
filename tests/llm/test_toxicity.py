import random

import numpy as np

from sparkrecon.llm import registry, toxicity


def brute(scores):
    """All maximal scoring segments by definition: find the best, then go on left and right of it."""

    def best(lo, hi):
        top = (0.0, 0, None)
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top[0] + 1e-9 or (abs(total - top[0]) <= 1e-9 and top[2] and j - i < top[1]):
                    top = (total, j - i, (i, j))
        return top

    def find(lo, hi):
        total, _, at = best(lo, hi)
        if not at:
            return []
        return find(lo, at[0]) + [(at[0], at[1], total)] + find(at[1] + 1, hi)

    return find(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(0, 40)
        gain = np.array([rng.choice([0, 0, 0, rng.random() * 3]) for _ in range(n)])
        at = np.flatnonzero(gain)
        got = toxicity.segments(at, gain[at], 0.7)
        want = brute([g if g > 0 else -0.7 for g in gain])
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op5_toxicity(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 100000), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for l in (labels, labels.limit(0)):
        model = toxicity.fit(docs, l)
        got = toxicity.score(docs, model)
        assert got.count() == 4
        assert got.filter("predicted = 1").count() == 0
        assert toxicity.score(docs.limit(0), model).count() == 0


def test_scores_by_definition(spark):
    """Segments found by definition, the extreme-value law and the logistic step written out, for short texts with ties."""
    words = "plain calm words here and there with more".split()
    texts = [(i, " ".join(random.Random(i).choice(words) for _ in range(12)) + (" vile filth vile" if i % 3 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(texts + texts[:3], "doc_id long, text string").selectExpr("*", "'x' score")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted", "passages", "n_passages"]
    for r in got.collect():
        gains = [max(float(model.bonus[f]) for f in toxicity.features(w)) for w in toxicity.TOKEN.findall(r.text.lower())]
        scores = [x[2] for x in brute([g if g > 0 else -model.drift for g in gains])]
        best = beyond = 0.0
        if scores:
            logs = [model.lam * s - np.log(model.k * len(gains)) for s in scores]
            best = min(60.0, -np.log(max(1 - np.exp(-np.exp(-max(logs))), 1e-300)))
            beyond = min(200.0, sum(x for x in logs if x > 3))
        z = model.weights[0] + model.weights[1] * best + model.weights[2] * np.log1p(beyond)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.3)
