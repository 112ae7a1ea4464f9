import numpy as np

from sparkrecon.llm import embeddings, registry


def brute(rows, threshold=0.93):
    """rows: (vec_id, embedding, label)."""
    n = len(rows)
    ok = [e is not None and label is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, label in rows]
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    out = []
    for i in range(n):
        least = min((rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((rows[i][0], links[i], least, rows[i][0] == least))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' n_links", "'y' _key")
    assert embeddings.near_duplicates(df.limit(0)).columns == ["vec_id", "embedding", "label", "_key", "n_links", "component_id", "kept"]
    assert not rows or {r["_key"] for r in embeddings.near_duplicates(df.limit(2)).collect()} == {"y"}
    return sorted(map(tuple, embeddings.near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_clusters_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(8):
            rows.append((len(rows), [float(x) for x in np.float32(centre + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.35]))], c % 2))
    assert run(spark, rows, tile=8) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None)]
    rows += [(8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_query(spark, sf):
    rows = list(map(tuple, spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()))
    assert sorted(map(tuple, registry.op6_embedding_near_duplicates(spark, sf).collect()), key=repr) == brute(rows)
