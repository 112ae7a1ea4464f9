from collections import defaultdict

from sparkrecon.llm import packing, registry


def brute(items, capacity):
    """items: (size, source, cluster), largest first; every bin is looked at."""
    bins = []
    for size, source, cluster in items:
        fits = [b for b in bins if b[0] >= size and source not in b[1] and (cluster < 0 or cluster not in b[2])]
        if fits:
            best = min(fits, key=lambda b: b[0])
        else:
            best = [capacity, set(), set()]
            bins.append(best)
        best[0] -= size
        best[1].add(source)
        best[2].add(cluster)
    return sorted(b[0] for b in bins)


def test_best_fit_finds_the_tightest_compatible_bin():
    import random

    rng = random.Random(1)
    for _ in range(100):
        items = sorted(((rng.randrange(1, 50), rng.randrange(4), rng.randrange(-1, 6)) for _ in range(60)), reverse=True)
        bins, offsets = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 100)
        left = defaultdict(lambda: 100)
        seen = set()
        for b, o, (size, source, cluster) in zip(bins, offsets, items, strict=True):
            assert o == 100 - left[b] and ("s", b, source) not in seen and (cluster < 0 or ("c", b, cluster) not in seen)
            seen |= {("s", b, source), ("c", b, cluster)}
            left[b] -= size
        assert min(left.values()) >= 0
        assert sorted(left.values()) == brute(items, 100)


def test_every_word_is_packed_once(spark, sf):
    rows = [(1, "a", 5, 5000), (1, "a", 5, 5000), (2, None, None, 3), (None, None, 7, 4), (3, "b", 7, None), (4, "b", 7, 0), (None, "c", None, 2048)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster long, size long")
    got = packing.pack(docs).collect()
    assert sum(r.size for r in got) == 5000 * 2 + 3 + 4 + 2048
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.size == 0)
        if r.size:
            bins[r.bin_id].append((r.bin_from, r.bin_from + r.size))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pack(docs.limit(0)).count() == 0
    assert sum(r.size for r in registry.op10_best_fit_packing(spark, sf).collect()) == sum(r.size for r in registry.op7_mix_sources(spark, sf).collect())


def test_pack_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3]), rng.randrange(1, 260)) for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, size long"), capacity=100).collect()
    pieces = [(min(100, size - low), i, low // 100, source, cluster) for i, source, cluster, size in rows for low in range(0, size, 100)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    want = brute([(size, source, -1 if cluster is None else cluster) for size, _, _, source, cluster in pieces], 100)
    left = defaultdict(lambda: 100)
    for r in got:
        left[r.bin_id] -= r.size
    assert sorted(left.values()) == want
    assert sorted((r.size, r.doc_id, r.piece) for r in got) == sorted(x[:3] for x in pieces)
