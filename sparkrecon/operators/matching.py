"""Matching of probes with ledger rows, level by level.

Every level is an equi-join (the shuffle or broadcast is Spark's choice, by measured size), so no level compares
each probe with each ledger row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrecon.operators.outputs import numbered
from sparkrecon.operators.store import shuffled, written


@dataclass(frozen=True)
class Level:
    """Keys of either side that must be equal, and what must hold besides; review marks matches to be looked at."""

    name: str
    probe_key: Column
    ledger_key: Column
    review: bool = False
    where: Column | None = None
    score: Column | None = None


def leveled_join(probes: DataFrame, ledger: DataFrame, levels: Sequence[Level], probe_id: str, row_no: str, every: bool = False) -> DataFrame:
    """Each probe with the ledger row of its first level that has one; within a level the best score, then the first row.

    every keeps all rows of that level. Unmatched probes stay, with a null level and needs_review. Null and blank keys
    match nothing. Adds match_level (from 1), match_name and needs_review. The levels' keys stand side by side in one row
    a probe and level, so that probes and ledger meet in one join; probes without any match are joined no further.
    """
    fill = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    keys = lambda of: F.filter(F.array(*[F.struct(F.lit(i).alias("lv"), fill(of(v)).alias("key")) for i, v in enumerate(levels, 1)]), lambda x: x["key"].isNotNull())
    left = probes.withColumn("_keys", F.explode(keys(lambda v: v.probe_key)))
    right = ledger.withColumn("_ledger_keys", F.explode(keys(lambda v: v.ledger_key)))
    met = left.join(shuffled(right), (F.col("_keys.lv") == F.col("_ledger_keys.lv")) & (F.col("_keys.key") == F.col("_ledger_keys.key")))
    level = F.col("_keys.lv")
    of_level = lambda f: F.coalesce(*[F.when(level == i, f(v)) for i, v in enumerate(levels, 1)])
    if any(v.where is not None for v in levels):
        met = met.filter(of_level(lambda v: F.lit(True) if v.where is None else v.where))
    score = of_level(lambda v: F.lit(0.0) if v.score is None else v.score.cast("double"))
    pairs = met.select(F.col(probe_id).alias("_probe"), *[F.col(c).alias(f"_l_{i}") for i, c in enumerate(ledger.columns)], F.col(row_no).alias("_row"), level.alias("match_level"), score.alias("_score"))
    order = Window.partitionBy("_probe")
    if every:
        picked = pairs.withColumn("_first", F.min("match_level").over(order)).filter("match_level = _first").dropDuplicates(["_probe", "_row"])
    else:
        picked = pairs.withColumn("_first", F.row_number().over(order.orderBy("match_level", F.col("_score").desc(), "_row"))).filter("_first = 1")
    joined = probes.join(shuffled(picked), F.col(probe_id) == F.col("_probe"), "left")
    name = F.coalesce(*[F.when(F.col("match_level") == i, F.lit(v.name)) for i, v in enumerate(levels, 1)])
    review = F.coalesce(*[F.when(F.col("match_level") == i, F.lit(v.review)) for i, v in enumerate(levels, 1)], F.lit(True))
    return joined.select(*probes.columns, "match_level", name.alias("match_name"), review.alias("needs_review"), *[F.col(f"_l_{i}").alias(c) for i, c in enumerate(ledger.columns)])


def suffix_pairs(a: DataFrame, key_a: str, b: DataFrame, key_b: str, least: int) -> DataFrame:
    """Pairs of which one key ends with the other, both at least so long.

    Each key is exploded into its own endings, which meet the other side's whole keys: an equi-join with as many
    rows as there are pairs, however alike the endings are.
    """

    def endings(df: DataFrame, key: str) -> DataFrame:
        n = F.length(key)
        return df.filter(n >= least).withColumn("_end", F.explode(F.transform(F.sequence(F.lit(least), n), lambda i: F.right(F.col(key), i))))

    longer = endings(a, key_a).join(shuffled(b), F.col("_end") == F.col(key_b)).drop("_end")
    shorter = a.join(shuffled(endings(b, key_b)), (F.col(key_a) == F.col("_end")) & (F.col(key_a) != F.col(key_b))).drop("_end")
    return longer.unionByName(shorter)


def substitution_neighbours(probes: DataFrame, number: str, ledger: DataFrame, ledger_number: str) -> DataFrame:
    """Pairs of digit strings of one length that differ in one place.

    Each string is joined under its forms with one place masked, so only neighbours meet.
    """

    def masked(df: DataFrame, column: str, into: str) -> DataFrame:
        c = F.col(column)
        forms = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("_"), F.substring(c, i + 1, F.length(c))))
        return df.filter(F.length(c) > 0).withColumn(into, F.explode(forms))

    pairs = masked(probes, number, "_mask").join(shuffled(masked(ledger, ledger_number, "_masked")), F.col("_mask") == F.col("_masked"))
    return pairs.filter(F.col(number) != F.col(ledger_number)).drop("_mask", "_masked")


def cascade(matches: DataFrame, probe_id: str, by_id: Column, by_name: Column, by_court: Column, most_names: int = 3) -> DataFrame:
    """Of candidate pairs flagged by what they agree in: those by id, else those by name if few enough, else by court number.

    With names alone, a row that agrees in the court number too settles it; over most_names names give nothing.
    """
    w = Window.partitionBy(probe_id)
    n = lambda c: F.sum(c.cast("int")).over(w)
    ids, names, both = n(by_id), n(by_name), n(by_name & by_court)
    keep = (
        F.when(ids > 0, by_id)
        .when(both > 0, by_name & by_court)
        .when(names > 0, by_name & (names <= most_names))
        .otherwise(by_court)
    )
    return matches.withColumn("_keep", keep).filter("_keep").drop("_keep")


#: Pairs of a group that one task may settle at once; larger groups go on in rounds.
SMALL_GROUP = 10_000


def assign_one_to_one(pairs: DataFrame, group: str, probe: str, target: str, order: Sequence[Column], small: int = SMALL_GROUP) -> DataFrame:
    """Greedy: within a group, pairs are taken in order if both ends are free. Ties go by probe, then target; null ends match nothing.

    A pair that comes first both for its probe and for its target is taken in any case: each round takes all such pairs
    and drops those that meet them, which leaves what the greedy walk leaves. Groups of at most small pairs end in one
    task each; no larger group ever meets in one. Of equal pairs one is kept.
    """
    columns = pairs.columns
    rest = numbered(pairs.dropna(subset=[probe, target]), [F.col(group), *order, F.col(probe), F.col(target)], "_o")
    one = F.row_number().over(Window.partitionBy(group, probe, target).orderBy("_o"))
    rest = written(rest.withColumn("_r", one).filter("_r = 1").drop("_r"))
    taken = None

    def settle(rows):
        used_probe, used_target, keep = set(), set(), []
        for p, t in zip(rows[probe], rows[target], strict=True):
            free = p not in used_probe and t not in used_target
            keep.append(free)
            if free:
                used_probe.add(p)
                used_target.add(t)
        return rows[keep][columns]

    while True:
        sizes = written(rest.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")))
        same = F.col(group).eqNullSafe(F.col("_g"))
        few = rest.join(sizes.filter(F.col("_n") <= small), same).drop("_g", "_n")
        done = few.groupBy(group).applyInPandas(lambda rows: settle(rows.sort_values("_o")), pairs.schema)
        if sizes.filter(F.col("_n") > small).isEmpty():
            return done if taken is None else taken.unionByName(done)
        done = written(done)
        taken = done if taken is None else taken.unionByName(done)
        many = rest.join(sizes.filter(F.col("_n") > small), same).drop("_g", "_n")
        first = lambda by, k: many.groupBy(F.col(group).alias(f"_g{k}"), F.col(by).alias(f"_{k}")).agg(F.min("_o").alias(f"_o{k}"))  # noqa: B023, E731
        on = lambda by, k: F.col(group).eqNullSafe(F.col(f"_g{k}")) & (F.col(by) == F.col(f"_{k}"))
        best = many.join(first(probe, "p"), on(probe, "p")).join(first(target, "t"), on(target, "t")).filter((F.col("_o") == F.col("_op")) & (F.col("_o") == F.col("_ot")))
        best = written(best.select(*columns))
        taken = taken.unionByName(best)
        used = lambda by, k: best.select(F.col(group).alias(f"_g{k}"), F.col(by).alias(f"_{k}"))  # noqa: B023, E731
        rest = written(many.join(used(probe, "p"), on(probe, "p"), "left_anti").join(used(target, "t"), on(target, "t"), "left_anti"))


def positional_fill(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column], group: str) -> DataFrame:
    """What is left of two sides of a group, paired by position."""
    a = left.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*left_order)))
    b = right.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*right_order)))
    return a.join(b, [group, "_at"]).drop("_at")
