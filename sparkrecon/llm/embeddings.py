"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import carry, scratch
from sparkrecon.llm.components import components


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of the unit vectors, each with its scale, the length of its error and the length of scale * code.

    For unit u = s q + e and v = t r + f, |u.v - s t q.r| <= |s q| |f| + |t r| |e| + |e| |f|: see possible().
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - near, axis=1), np.linalg.norm(near, axis=1)


def possible(a, b, threshold: float) -> np.ndarray:
    """Pairs whose cosine may reach the threshold, from the product of the codes and the error bounds.

    Products of int8 codes are whole numbers; single precision holds them exactly up to 1,000 dimensions, so wider
    vectors are multiplied in double precision.
    """
    (q, s, e, n), (r, t, f, m) = a, b
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    product = (q.astype(kind) @ r.astype(kind).T).astype(np.float64) * s[:, None] * t[None, :]
    slack = n[:, None] * f[None, :] + e[:, None] * m[None, :] + e[:, None] * f[None, :]
    return product + slack >= threshold - 1e-9


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links a-b among n nodes, each tree a star about its least node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(before, root):
            break
    return [(i, r) for i, r in enumerate(root.tolist()) if i != r]


def _tiles(threshold: float):
    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        """Links between the tile's sides 0 and 1, or within side 0 alone: link counts, and a forest of them."""
        vectors = np.stack([np.frombuffer(x, dtype=np.float64) for x in group["vector"]])
        side, copies, keys = group["side"].to_numpy(), group["copies"].to_numpy(), group["key"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = len(right) == 0
        right = left if same else right
        if group["diagonal"].iloc[0] != same or not len(left):
            return pd.DataFrame({"key": [], "other": [], "n": []}, dtype=object)
        coded = quantise(vectors)
        i, j = np.nonzero(possible([x[left] for x in coded], [x[right] for x in coded], threshold))
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        length = np.linalg.norm(vectors, axis=1)
        kept = [np.empty(0, bool)]
        for k in range(0, len(i), 65536):  # full precision, for the pairs that may reach the threshold
            x, y = i[k : k + 65536], j[k : k + 65536]
            kept.append((vectors[x] * vectors[y]).sum(axis=1) / (length[x] * length[y]) >= threshold)
        kept = np.concatenate(kept)
        i, j = i[kept], j[kept]
        n = np.bincount(i, weights=copies[j], minlength=len(keys)) + np.bincount(j, weights=copies[i], minlength=len(keys))
        linked = np.flatnonzero(n)
        edges = _forest(i, j, len(keys)) if len(i) else []
        return pd.DataFrame({
            "key": [keys[k] for k in linked] + [keys[a] for a, _ in edges],
            "other": [None] * len(linked) + [keys[b] for _, b in edges],
            "n": [int(n[k]) for k in linked] + [0] * len(edges),
        }, dtype=object)

    return pairs


def near_duplicates(rows: DataFrame, threshold: float = 0.93, tile: int = 1024) -> DataFrame:
    """Link rows (vec_id, embedding, label) of equal label whose cosine reaches the threshold.

    Equal vectors of a label are one key with a count of copies. Each label's keys are dealt over tiles of about tile
    keys; each pair of tiles is a task that multiplies int8 codes, recomputes in double precision the pairs which the
    error bounds leave open, and returns link counts and a spanning forest of its links: rows in
    proportion to keys, not to pairs.

    An added column takes the place of an input column of its name; other columns are carried whatever their names.
    Returns every row (its columns kept) with n_links, component_id (least vec_id reachable) and kept
    (vec_id = component_id). A null label, and a vector that is null, empty, zero or holds null, NaN or infinite
    components, links with nothing: n_links 0, its own component. Vectors of different lengths do not link. A
    null vec_id takes no part in the least id; a component of null ids has a null id and is kept.
    """
    given_rows, needed = rows, ["vec_id", "embedding", "label"]
    rows = carry.packed(rows, needed)
    values = F.col("embedding").cast("array<double>")
    fine = (
        (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0)
        & F.col("label").isNotNull()
    )

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        """Scaled by a power of two to a largest component near 1, so no square over- or underflows."""
        out = []
        for x in vectors:
            if x is None:
                out.append(None)
                continue
            x = np.asarray(x, dtype=np.float64)
            x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
            out.append((x + 0.0).tobytes())
        return pd.Series(out)

    given = rows.withColumn("_vector", packed(F.when(F.coalesce(fine, F.lit(False)), values)))
    given = given.withColumn(
        "_key", F.when(F.col("_vector").isNotNull(), F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), F.col("_vector"))))
    )
    keys = (
        given.filter("_key is not null")
        .groupBy("_key")
        .agg(F.first("label").alias("_label"), F.first("_vector").alias("_vector"), F.count(F.lit(1)).alias("_copies"), F.min("vec_id").alias("_least"))
    )
    keys = scratch.table(keys.withColumn("_width", F.length("_vector")), "vectors")
    groups = keys.groupBy("_label", "_width").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_tiles"))
    groups = scratch.table(groups.select(F.col("_label").alias("_l"), F.col("_width").alias("_w"), "_tiles"), "tiles")
    dealt = keys.join(groups, (F.col("_label") == F.col("_l")) & (F.col("_width") == F.col("_w"))).withColumn(
        "_tile", F.pmod(F.xxhash64("_key"), F.col("_tiles"))
    )
    sides = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).select(
        F.col("_label").alias("label"), F.col("_width").alias("width"),
        F.least("_tile", "_with").alias("low"), F.greatest("_tile", "_with").alias("high"),
        (F.col("_tile") > F.col("_with")).cast("int").alias("side"), (F.col("_tile") == F.col("_with")).alias("diagonal"),
        F.col("_key").alias("key"), F.col("_vector").alias("vector"), F.col("_copies").alias("copies"),
    )
    found = scratch.table(
        sides.groupBy("label", "width", "low", "high").applyInPandas(_tiles(threshold), "key string, other string, n long"), "links"
    )
    links = found.filter("other is null").groupBy(F.col("key").alias("_n_key")).agg(F.sum("n").alias("_others"))
    roots = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    roots = roots.select(F.col("node").alias("_r_key"), F.col("root").alias("_root"))
    each = keys.select("_key", "_copies", "_least").join(links, F.col("_key") == F.col("_n_key"), "left").join(roots, F.col("_key") == F.col("_r_key"), "left")
    each = scratch.table(
        each.select(F.col("_key").alias("_of"), F.coalesce("_root", "_key").alias("_root"), (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"), "_least"), "keys"
    )
    least = each.groupBy("_root").agg(F.min("_least").alias("_component")).withColumnRenamed("_root", "_of_root")
    each = scratch.table(each.join(least, F.col("_root") == F.col("_of_root")).select("_of", "_links", "_component"), "classes")
    out = given.drop("_vector").join(each, F.col("_key") == F.col("_of"), "left")
    component = F.when(F.col("_of").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    out = out.withColumns({
        "n_links": F.coalesce("_links", F.lit(0)).cast("long"), "component_id": component, "kept": F.col("vec_id").eqNullSafe(component),
    })
    return carry.unpacked(out, given_rows, needed, ["n_links", "component_id", "kept"])
