"""Ledger and cache upkeep: last wins, unions by priority, write-back, insert or ignore, anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order (for last wins, order by the row number descending)."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


def union_by_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """All keys of several tables; the row of the earliest table that has it (of several there, that of the least hash)."""
    both, whole = None, F.xxhash64(*sources[0].columns)
    for i, df in enumerate(sources):
        df = df.withColumn("_from", F.lit(i))
        both = df if both is None else both.unionByName(df)
    return one_per_key(both, [key], [F.col("_from"), whole]).drop("_from")


def insert_or_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the new rows whose key it doesn't have; of new rows of one key, that of the least hash."""
    new = one_per_key(new, [key], [F.xxhash64(*new.columns)])
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def unexpired(cache: DataFrame, updated: str, today: Column, days: int) -> DataFrame:
    """Rows updated under so many days ago; none for a limit of 0 or less."""
    return cache.filter(F.lit(days > 0) & (F.datediff(today, F.col(updated)) < days))


def write_back(ledger: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The ledger with what updates have that is not empty. updates holds a row a key at most."""
    renamed = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = ledger.join(renamed, F.col(key) == F.col("_key"), "left")
    new = {c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)) for c in columns}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in ledger.columns])


def unmatched(rows: DataFrame, matched: DataFrame, key: str, reason: str, order: Sequence[Column], most: int) -> DataFrame:
    """A report of the first rows without a match."""
    return rows.join(matched, key, "left_anti").withColumn("reason", F.lit(reason)).orderBy(*order).limit(most)


def completeness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """failed with no value at all, warning with some missing (listed), else success."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing = F.concat_ws(",", *[F.when(empty(c), F.lit(c)) for c in columns])
    n = sum((empty(c).cast("int") for c in columns), F.lit(0))
    return rows.withColumn("missing", missing).withColumn("status", F.when(n == len(columns), "failed").when(n > 0, "warning").otherwise("success"))
