"""Best-fit packing of documents into sequences, with conflicts of source and of duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import text


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items come largest first.

    Open bins stand in order of what is left in them, each with a bitmap of its sources and one of its clusters. The
    search begins at the bin that the item fills most nearly and goes on to the next larger residual until a bin
    has neither the item's source nor its cluster; without one a new bin is opened. A cluster below 0 is no conflict.
    """
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    of_sources, of_clusters, bins, offsets = [], [], [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        for k in range(bisect_left(left, (size, -1)), len(left)):
            b = left[k][1]
            if not (of_sources[b] & s or of_clusters[b] & c):
                residual = left.pop(k)[0]
                break
        else:
            b, residual = len(of_sources), capacity
            of_sources.append(0)
            of_clusters.append(0)
        of_sources[b] |= s
        of_clusters[b] |= c
        bins.append(b)
        offsets.append(capacity - residual)
        if residual > size:
            insort(left, (residual - size, b))
    return bins, offsets


def same_words(column: Column) -> Column:
    """A duplicate cluster: texts of the same words, but for letter case and white space; null for none."""
    words = text.words(F.lower(column))
    return F.when(F.size(words) > 0, F.xxhash64(words))


def pack(rows: DataFrame, capacity: int = 2048, shard_rows: int = 2048, seed: int = 11) -> DataFrame:
    """Pack rows (doc_id, source, cluster, size) into bins of capacity.

    A document over capacity is cut into full pieces, each a bin of its own, and a rest. Rows are dealt by a seeded
    hash over shards of about shard_rows rows, and each shard is packed alone, largest first, ties by doc_id.
    In a bin no two pieces share a source or a cluster. Returns a row a piece: doc_id, piece, span_from, span_to (of
    the document), bin_id, bin_from (where it lies in the bin), size. Documents of null or no size get one piece of
    size 0 in no bin (null bin_id). A null source is a source; a null cluster conflicts with nothing.
    """
    n = max(1, -(-rows.count() // shard_rows))
    size = F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))
    slim = rows.select("doc_id", F.col("source").cast("string").alias("source"), "cluster", size.alias("whole"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster", "whole"), F.lit(n))
    starts = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = slim.withColumn("shard", shard).select("*", F.posexplode(starts).alias("piece", "span_from"))
    pieces = pieces.withColumn("span_to", F.least("whole", F.col("span_from") + capacity)).withColumn("size", F.col("span_to") - F.col("span_from"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        some = group[group["size"] > 0]
        sources = pd.factorize(some["source"], use_na_sentinel=False)[0].tolist()
        twice = some["cluster"].where(some["cluster"].duplicated(keep=False))
        clusters = pd.factorize(twice)[0].tolist()  # -1: met once here, or null
        bins, offsets = best_fit(some["size"].tolist(), sources, clusters, capacity)
        out = group[["doc_id", "piece", "span_from", "span_to", "size"]].copy()
        first = int(group["shard"].iloc[0]) << 32
        out["bin_id"] = pd.Series([first + b for b in bins], index=some.index, dtype="Int64").reindex(out.index)
        out["bin_from"] = pd.Series(offsets, index=some.index, dtype="Int64").reindex(out.index)
        return out[["doc_id", "piece", "span_from", "span_to", "bin_id", "bin_from", "size"]]

    kind = "doc_id long, piece int, span_from long, span_to long, bin_id long, bin_from long, size long"
    return pieces.groupBy("shard").applyInPandas(packed, kind)
