"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), the table (node, root) of every node that has a link; root is one node of its component.

    Each round maps every node to the least of itself and its neighbours and keeps the edges between different
    images, so a star vanishes in one round and other shapes shrink fast. What a round maps is written to the shared
    folder; at the end the rounds are composed, last to first. edges should be a written table: it is read three times.
    Loops and repeated edges do no harm, null ends are left out.
    """
    kept = edges.select("a", "b").filter("a is not null and b is not null")
    left = kept.filter("a <> b")
    nodes = kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct()
    rounds: list[DataFrame] = []
    while n := left.count():
        both = left.union(left.select("b", "a"))
        image = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
        image = scratch.table(image.select("node", F.least("node", "_b").alias("root")), "images")
        rounds.append(image)
        ends = left.join(image, left["a"] == image["node"]).select(F.col("root").alias("a"), "b")
        ends = ends.join(image, ends["b"] == image["node"]).select("a", F.col("root").alias("b"))
        left = scratch.table(ends.filter("a <> b").distinct(), "edges", n)
    roots = None
    for image in reversed(rounds):
        if roots is None:
            roots = image
            continue
        later = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        roots = image.join(later, image["root"] == later["_node"], "left").select("node", F.coalesce("_root", "root").alias("root"))
    if roots is None:
        return nodes.select("node", F.col("node").alias("root"))
    found = roots.select(F.col("node").alias("_node"), "root")
    return nodes.join(found, nodes["node"] == found["_node"], "left").select("node", F.coalesce("root", "node").alias("root"))
