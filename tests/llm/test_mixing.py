import re

from pyspark.sql import functions as F

from sparkrecon.llm import mixing, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """sizes: (source, size); sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(w for s, w in weight.items() if s not in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and share[s] > 2 * sizes[s]}
        if not over:
            return share
        full |= over


def seats(votes, n):
    got = dict.fromkeys(votes, 0)
    for _ in range(n):
        got[min(votes, key=lambda s: (-votes[s] / (2 * got[s] + 1), s))] += 1
    return got


def test_seats_go_to_the_highest_quotients(spark):
    import random

    rng = random.Random(3)
    for n in (0, 1, 7, 50, 333):
        votes = {i: float(rng.choice([0, 1, 1, 5, 1000 * rng.random()])) for i in range(12)}
        votes[0] = 3.0
        df = spark.createDataFrame([(True, i, v, n) for i, v in votes.items()], "g boolean, party long, votes double, seats long")
        got = {r.party: r.got for r in mixing.apportion(df, ["g"], "party", "votes", "seats", "got").collect()}
        assert got == seats(votes, n)


def test_query_meets_its_targets(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op7_mix_sources(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, registry.op7_mix_sources(spark, sf).collect()))
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    assert {r.doc_id: r.size for r in got} == size
    sources = {}
    for i, d in docs.items():
        sources[d.source] = sources.get(d.source, 0) + size[i]
    want, taken = targets(sources), dict.fromkeys(sources, 0)
    for r in got:
        s = docs[r.doc_id].source
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sources[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 130 for s in sources)


def test_odd_rows(spark):
    rows = [(1, "a", 10), (1, "a", 10), (None, None, 5000), (2, "", None), (3, "a", 0), (None, None, 70)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    clashing = df.withColumn("_source", F.lit("x")).withColumn("PASSES", F.lit("y")).withColumn("_quota", F.lit("z"))
    out = mixing.mix(clashing)
    assert out.columns[:5] == ["doc_id", "source", "size", "_source", "_quota"] and out.columns.count("passes") == 1
    assert {(r["_source"], r["_quota"]) for r in out.collect()} == {("x", "z")}
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("size = 0")).collect()} == {0}


def test_mix_equals_quotas(spark):
    """One shard a source: each takes exactly its seats, as whole passes and a run of blocks."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([0, 3, 70, 640])) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    want = targets(sizes)
    quota = seats({(s is None, s): v for s, v in want.items()}, int(sum(want.values()) / 64 + 0.5))
    for source, size in sizes.items():
        mine = [r for r in got if r.source == source]
        n = -(-size // 64)
        blocks = min(quota[source is None, source], 2 * n)
        passes, rest = divmod(blocks, n)
        assert {r.passes for r in mine} == {passes}
        assert all(passes * r.size <= r.taken <= (passes + 1) * r.size for r in mine)
        last = size - (n - 1) * 64
        assert sum(r.taken for r in mine) - passes * size in (rest * 64, (rest - 1) * 64 + last)
