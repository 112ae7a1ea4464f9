"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, text

#: A token and its beginnings (inflected forms share them) are hashed to so many buckets: the model has one size.
BUCKETS = 1 << 20
BEGINNINGS = (3, 4, 5, 6, 7, 8)
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """bonus: of each bucket, 0 unless its log-odds are significant; drift: taken off for every other token.

    lam and k: of the extreme-value law for the best segment of clean text; weights: of the final logistic step.
    """

    bonus: np.ndarray
    drift: float
    lam: float
    k: float
    weights: tuple[float, float, float]


def features(token: str) -> list[int]:
    """Buckets of a token and of its beginnings."""
    import xxhash

    names = [token + "$", *(token[:n] for n in BEGINNINGS if len(token) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


class Gains:
    """The gain of each token of a text: the largest bonus of its features. Remembers up to a million tokens."""

    def __init__(self, bonus: np.ndarray):
        self.bonus, self.known = bonus, {}

    def __call__(self, value: str | None) -> np.ndarray:
        found = TOKEN.findall((value or "").lower())
        if len(self.known) > 1_000_000:
            self.known.clear()
        for w in set(found).difference(self.known):
            self.known[w] = float(self.bonus[features(w)].max())
        return np.fromiter(map(self.known.__getitem__, found), dtype=float, count=len(found))


def log_odds(toxic: np.ndarray, clean: np.ndarray, docs: tuple[int, int], prior: float, least_z: float, least_docs: int) -> np.ndarray:
    """Log-odds of a document's holding each feature, with a symmetric Dirichlet prior on presence; 0 unless z >= least_z.

    toxic, clean: how many documents of either kind hold the feature (a document that repeats it counts once, so
    junk that repeats a token teaches nothing); docs: how many there are.
    """
    t, c = toxic + prior, clean + prior
    odds = np.log(t / (docs[1] + 2 * prior)) - np.log(c / (docs[0] + 2 * prior))
    z = odds / np.sqrt(1 / t + 1 / c)
    return np.where((z >= least_z) & (toxic >= least_docs), odds, 0.0)


def segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text, in order, in linear time.

    at: places of tokens with a gain; all other tokens cost drift. Each candidate keeps the cumulative score before
    and after it; a new one is merged to the left as far as that makes a better segment.
    """
    found: list[list[float]] = []  # first, last, before, after
    nearest: list[int] = []  # the last earlier candidate with a lower score before it, or -1
    level, last = 0.0, -1
    for place, plus in zip(at.tolist(), gain.tolist(), strict=True):
        level -= drift * (place - last - 1)
        new = [place, place, level, level + plus]
        level, last = level + plus, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = nearest[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                nearest.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], nearest[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in found]


def passages(gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    at = np.flatnonzero(gain)
    return segments(at, gain[at], drift)


def evidence(model: Model, n: int, scores: list[float]) -> tuple[float, float]:
    """-ln p of the best segment of n tokens under the extreme-value law; segments' logs beyond e^-3, summed."""
    if not len(scores):
        return 0.0, 0.0
    logs = [model.lam * s - math.log(model.k * max(1, n)) for s in scores]
    p = -math.expm1(-math.exp(min(50.0, -max(logs))))
    return min(60.0, -math.log(max(p, 1e-300))), min(200.0, sum(x for x in logs if x > 3))


def probability(model: Model, n: int, scores: list[float]) -> float:
    best, total = evidence(model, n, scores)
    w0, w1, w2 = model.weights
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, w0 + w1 * best + w2 * math.log1p(total)))))


def _rate(gains: np.ndarray, drift: float, n: int) -> float:
    """The positive root of mean exp(lam * score) = 1 over n tokens, of which some have gains and the rest cost drift."""
    rest = 1 - len(gains) / n
    low, high = 1e-6, 1.0
    value = lambda x: np.exp(np.minimum(x * gains, 500.0)).sum() / n + rest * math.exp(-x * drift) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3, 1, 1])
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * np.array([1e-3, 1, 1]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit(
    docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, prior: float = 0.5, least_z: float = 3.0, least_docs: int = 3, drift: float = 0.1
) -> Model:
    """Learn from the labelled documents outside fold 2 of 4, at most most_rows of them (those of least hash).

    Three quarters of those give the log-odds, the rest the calibration. What comes to the driver is two counts a
    bucket and a calibration row's segment scores: bounded by BUCKETS and most_rows. With no labelled row of
    either kind the model finds nothing.
    """
    spark = docs.sparkSession
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(text.fold(F.col("doc_id"), 4) != 2)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = rows.select(F.col("doc_id").alias("_label_of"), F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0).alias("held"))
    mine = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_label_of")).select("text", "toxic", "held")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total, n = {}, np.zeros((2, BUCKETS), dtype=np.int64), [0, 0]
        for batch in batches:
            for value, label in zip(batch["text"], batch["toxic"], strict=True):
                found = set(TOKEN.findall((value or "").lower()))
                for w in found.difference(known):
                    known[w] = features(w)
                total[label, list({b for w in found for b in known[w]})] += 1
                n[label] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"bucket": [-1, *used.tolist()], "toxic": [n[1], *total[1, used].tolist()], "clean": [n[0], *total[0, used].tolist()]})

    sums = mine.filter("not held").mapInPandas(counted, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.filter(F.col("bucket").eqNullSafe(-1) | (F.col("toxic") >= least_docs))
    total, n_docs = np.zeros((2, BUCKETS)), (0, 0)
    for bucket, toxic, clean in sums.toPandas().itertuples(index=False):
        if bucket < 0:
            n_docs = (clean, toxic)
        else:
            total[1, bucket], total[0, bucket] = toxic, clean
    bonus = log_odds(total[1], total[0], n_docs, prior, least_z, least_docs).astype(np.float32)
    shared = spark.sparkContext.broadcast(bonus)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = Gains(shared.value)
        for batch in batches:
            out = []
            for value, label in zip(batch["text"], batch["toxic"], strict=True):
                g = gains(value)
                out.append((len(g), [s for _, _, s in passages(g, drift)], g[g > 0].tolist() if not label else [], label))
            yield pd.DataFrame(out, columns=["n", "scores", "gains", "toxic"])

    held = mine.filter("held").mapInPandas(best, "n long, scores array<double>, gains array<double>, toxic int").toPandas()
    clean = held[held["toxic"] == 0]
    usual = float(bonus[bonus > 0].mean()) if (bonus > 0).any() else 1.0
    gains = np.concatenate([np.array([usual]), *clean["gains"]])  # one token more, so that the law exists
    lam = _rate(gains, drift, max(1000, int(clean["n"].sum())))
    top = np.array([max(s, default=0.0) for s in clean["scores"]])
    # the maximum-likelihood K of the law P(best <= s) = exp(-K n exp(-lam s)) with lam given
    spread = float((clean["n"].to_numpy() * np.exp(-lam * top)).sum()) if len(clean) else 0.0
    model = Model(bonus, drift, lam, max(1e-9, len(clean) / spread) if spread else 1.0, (0.0, 0.0, 0.0))
    x, y = [], []
    for n, scores, _, toxic in held.itertuples(index=False):
        first, beyond = evidence(model, n, scores)
        x.append((1.0, first, math.log1p(beyond)))
        y.append(toxic)
    weights = _logistic(np.array(x), np.array(y, dtype=float)) if len(set(y)) == 2 else (-2.0, 0.3, 0.5)
    return Model(bonus, drift, lam, model.k, weights)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add held_out (fold 2 of 4), score, predicted, n_passages and passages (first and last token, score) to docs (doc_id, text).

    Null and empty texts have no passage and get the score of no evidence. Texts are scored whole. No shuffle. An added
    column takes the place of an input column of its name; other columns are carried whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<first:int,last:int,score:double>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        gains = Gains(m.bonus)
        for texts in batches:
            out = []
            for value in texts:
                g = gains(value)
                found = passages(g, m.drift)
                out.append((probability(m, len(g), [s for _, _, s in found]), [{"first": a, "last": z, "score": s} for a, z, s in found]))
            yield pd.DataFrame(out, columns=["score", "passages"])

    needed = ["doc_id", "text"]
    rows = (
        carry.packed(docs, needed)
        .withColumn("_judged", judged("text"))
        .withColumn("held_out", text.fold(F.col("doc_id"), 4) == 2)
        .withColumn("score", F.col("_judged.score"))
        .withColumn("predicted", (F.col("_judged.score") >= threshold).cast("int"))
        .withColumn("passages", F.col("_judged.passages"))
        .withColumn("n_passages", F.size("passages"))
    )
    return carry.unpacked(rows, docs, needed, ["held_out", "score", "predicted", "passages", "n_passages"])
