"""The caller's other columns, carried through an operator as one struct, so that no name of theirs meets one inside."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCT = "_carried"


def _others(df: DataFrame, needed: Iterable[str]) -> list[str]:
    own = {c.lower() for c in needed}
    return [c for c in df.columns if c.lower() not in own]


def packed(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """The columns that the operator needs, all others in a struct."""
    needed = list(dict.fromkeys(needed))
    others = _others(df, needed)
    return df.select(*needed, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias(STRUCT)] if others else []))


def unpacked(out: DataFrame, like: DataFrame, needed: Iterable[str], added: Iterable[str]) -> DataFrame:
    """like's columns in their order, then the added ones; an added column takes the place of one of its name.

    Names are compared without case, as Spark does.
    """
    added = list(added)
    taken, others = {c.lower() for c in added}, set(_others(like, needed))
    kept = [c for c in like.columns if c.lower() not in taken]
    return out.select(*[F.col(STRUCT).getField(c).alias(c) if c in others else F.col(f"`{c}`") for c in kept], *added)
