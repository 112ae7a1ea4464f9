"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkrecon.llm import carry, scratch
from sparkrecon.llm.ranking import ranked


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Give each row of sources (source, source_size, ...) a target of words.

    Sources in code point order, null last, weigh as weights repeat. The targets share share * all words by
    weight; none exceeds cap * its source's size, and what is over goes to the others by weight until none is
    above. Each round sends three sums to the driver.
    """
    table = ranked(sources, [], [F.col("source").asc_nulls_last()], "_rank")
    choose = F.array(*[F.lit(float(w)) for w in weights])
    table = scratch.table(
        table.withColumn("_weight", F.get(choose, ((F.col("_rank") - 1) % len(weights)).cast("int"))), "sources"
    )
    limit = F.col("source_size") * float(cap)
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share)).first()[0])
    left, weight, level = total, None, 0.0
    while True:
        full = limit <= F.col("_weight") * level
        held, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))
        ).first()
        if not open_weight:
            return table.withColumn("target", limit)
        if weight == open_weight:
            break
        left, weight = total - held, open_weight
        level = left / weight
    share_of = F.col("_weight") * left / weight
    return table.withColumn("target", F.when(limit <= F.col("_weight") * level, limit).otherwise(share_of))


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, into: str) -> DataFrame:
    """Sainte-Laguë: the seats of each group go to the highest quotients votes / (2k - 1); ties to the first party.

    Seats that any divisor near the final one grants are given at once: with V votes, T seats and S parties the
    final divisor lies between V / (T + S/2) and V / (T - S/2), so only a few quotients a party are compared.
    Without a group there is one, and its three sums are constants.
    """
    sums = parties.groupBy(*group).agg(
        F.sum(votes).alias("_v"), F.count(F.when(F.col(votes) > 0, 1)).alias("_s"), F.first(seats).alias("_t")
    )
    near = _with(parties, sums, group, ["_v", "_s", "_t"])
    near = (
        near.withColumn("_unit", F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0))
        .withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_unit") * (F.col("_t") - F.col("_s") / 2) + 0.5) - 1))
        .withColumn("_hi", F.floor(F.col("_unit") * (F.col("_t") + F.col("_s") / 2) + 0.5) + 1)
    )
    near = scratch.table(near, "seats")
    rivals = near.filter(F.col(votes) > 0).select(
        *group, party, F.col(votes).alias("_votes"), F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k")
    )
    order = [(F.col("_votes") / (2 * F.col("_k") - 1)).desc(), F.col(party).asc_nulls_last(), F.col("_k").asc()]
    won = ranked(rivals, group, order, "_place")
    left = near.groupBy(*group).agg((F.first("_t") - F.sum("_lo")).alias("_left"))
    won = _with(won.select(*group, party, "_place"), left, group, ["_left"]).filter(F.col("_place") <= F.col("_left"))
    extra = won.groupBy(*group, party).agg(F.count(F.lit(1)).alias("_extra"))
    near = near.alias("_a").join(extra.alias("_b"), _same("_a", "_b", [*group, party]), "left")
    seats_of = (F.col("_lo") + F.coalesce(F.col("_extra"), F.lit(0))).cast("long").alias(into)
    return near.select(*[F.col(f"_a.{c}") for c in parties.columns], seats_of)


def _with(rows: DataFrame, sums: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """rows with the sums of their group; the sums of a single group are brought to the driver and put in as constants."""
    if not group:
        one = sums.first()
        return rows.withColumns({c: F.lit(one[c]).cast(sums.schema[c].dataType) for c in columns})
    return rows.alias("_a").join(sums.alias("_b"), _same("_a", "_b", group)).select("_a.*", *[f"_b.{c}" for c in columns])


def _same(a: str, b: str, columns: list[str]) -> Column:
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def mix(
    rows: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    shard_rows: int = 512,
    seed: int = 20240229,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Choose how often each document of rows (doc_id, source, size, ...) is taken.

    A source's documents are dealt by a seeded hash over shards of about shard_rows documents, laid end to end in
    seeded order and cut into blocks of block_words words. The blocks that all targets pay for are apportioned to
    sources, and each source's blocks to its shards, by highest quotients. A shard takes its quota as whole
    passes and then as a run of blocks from a seeded place, round the end; it never takes a block over
    floor(cap) times, so no document exceeds cap times its size.

    Adds source_size, target, taken (words, repeats counted), passes (whole repeats) and the spans of words taken
    once more: [span1_from, span1_to) and [span2_from, span2_to). Null sizes count as 0 words; empty documents are
    taken 0 times; a null source is a source of its own; rows that agree in doc_id, size and ties are
    interchangeable, so reruns agree. An added column takes the place of an input column of its name; other columns are
    carried whatever their names.
    """
    given, needed = rows, ["doc_id", "source", "size", *ties]
    rows = carry.packed(rows, needed).withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sources = targets(scratch.table(by_source, "by-source"), weights, share, cap)
    blocks = F.lit(float(block_words))
    paid = float(sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    sources = sources.withColumn("_blocks", F.lit(int(paid / block_words + 0.5)).cast("long"))
    sources = apportion(sources, [], "source", "target", "_blocks", "_quota")
    sources = scratch.table(
        sources.select(
            F.col("source").alias("_source"), "source_size", "target", F.col("_quota").alias("_source_quota"),
            F.greatest(F.lit(1), F.ceil(F.col("_docs") / shard_rows)).alias("_shards"),
        ),
        "quotas",
    )
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), *[F.col(c) for c in ties]), F.col("_shards"))
    )
    shards = dealt.groupBy("_source", "_shard").agg(
        F.sum("size").alias("_shard_size"), F.first("_source_quota").alias("_source_quota")
    )
    shards = apportion(scratch.table(shards, "shards"), ["_source"], "_shard", "_shard_size", "_source_quota", "_quota")
    shards = shards.select(
        F.col("_source").alias("_s_source"), F.col("_shard").alias("_s_shard"), F.col("_shard_size").alias("_all_words"), "_quota"
    )
    shards = scratch.table(shards, "shard-quotas")
    laid = Window.partitionBy("_source", "_shard").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col("doc_id"), *[F.col(c) for c in ties]), "doc_id", "size", *ties
    )
    n = F.ceil(F.col("_all_words") / blocks)
    quota = F.least(F.col("_quota"), n * int(cap))
    rest = F.col("_rest")
    first = F.col("_first")

    def within(low: Column, high: Column) -> tuple[Column, Column]:
        start = F.least(F.greatest(low - F.col("_at"), F.lit(0)), F.col("size"))
        return start, F.greatest(start, F.least(high - F.col("_at"), F.col("size")))

    placed = (
        dealt.join(shards, F.col("_source").eqNullSafe(F.col("_s_source")) & (F.col("_shard") == F.col("_s_shard")))
        .withColumn("_at", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_n", n)
        .withColumn("passes", F.when(F.col("_n") > 0, F.floor(quota / F.col("_n"))).otherwise(0).cast("long"))
        .withColumn("_rest", quota - F.col("passes") * F.col("_n"))
        .withColumn("_first", F.when(F.col("_n") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.col("_n"))).otherwise(0))
    )
    low1, high1 = within(first * block_words, F.least(first + rest, F.col("_n")) * block_words)
    low2, high2 = within(F.lit(0), F.greatest(first + rest - F.col("_n"), F.lit(0)) * block_words)
    spans = {"span1_from": low1, "span1_to": high1, "span2_from": low2, "span2_to": high2}
    placed = placed.withColumns({k: v.cast("long") for k, v in spans.items()})
    taken = F.col("passes") * F.col("size") + F.col("span1_to") - F.col("span1_from") + F.col("span2_to") - F.col("span2_from")
    return carry.unpacked(placed.withColumn("taken", taken), given, needed, ["source_size", "target", "taken", "passes", *spans])
