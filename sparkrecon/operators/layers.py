"""Rules, corrections and settings kept as tables in layers: merged by the first layer that has them, applied as Columns.

Layers are configuration, not data: their merged rows come to the driver, where they are made into Columns, and more
than a stated number of them is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkrecon.functions import documents as D
from sparkrecon.functions import text as T
from sparkrecon.functions.rules import Rule, best_hit

#: A rule's row: layer 0 wins over layer 1; place orders the rules of a field, of equal confidence the first stays.
RULE_ROWS = "layer int, place int, field string, name string, pattern string, weight double, part int, post string"
CORRECTION_ROWS = "doc_type string, place int, wrong string, right string"
SETTING_ROWS = "layer int, name string, value string"
MOST = 10_000

# Post-processors by the names that rules call them.
POST: dict[str, Callable[[Column], Column]] = {"parse_amount": lambda c: T.amount_text(T.amount(c)), "normalize_date": D.normal_date, "clean_name": T.person}

S = TypeVar("S")


def first_wins(layers: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first by order, of rows that tie there the least by the other columns."""
    rest = [c for c in layers.columns if c not in key]
    best = layers.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def _rows(merged: DataFrame, most: int) -> list[Row]:
    found = merged.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows of configuration: give most, or keep them as data")
    return found


def merged_rules(layers: DataFrame, most: int = MOST) -> dict[str, list[tuple[Rule, str | None]]]:
    """Each field's rules with their post-processors, by place: of two rules of one name that of the first layer. Rules without a field, name or pattern are left out."""
    rows = _rows(first_wins(layers.dropna(subset=["field", "name", "pattern"]), ["field", "name"], ["layer", "place"]), most)
    found: dict[str, list[tuple[Rule, str | None]]] = {}
    for r in sorted(rows, key=lambda r: (r["field"], r["place"] or 0, r["name"])):
        found.setdefault(r["field"], []).append((Rule(r["name"], r["pattern"], 1.0 if r["weight"] is None else r["weight"], 1 if r["part"] is None else r["part"]), r["post"]))
    return found


def post_processed(c: Column, name: str | None) -> Column:
    """c by the post-processor of that name; an unknown name leaves it as it is."""
    return POST[name](c) if name in POST else c


def extracted(rows: DataFrame, text: str, layers: DataFrame, most: int = MOST) -> DataFrame:
    """rows with a column for each field of the rules: struct<value, confidence, source> of the best hit, null without one.

    A field takes the place of a column of its name. Null texts have no hits.
    """
    columns = {}
    for field, found in merged_rules(layers, most).items():
        hit = best_hit(F.col(text), [r for r, _ in found])
        value = hit["value"]
        for name in {p for _, p in found if p in POST}:
            value = F.when(hit["source"].isin(*[r.name for r, p in found if p == name]), post_processed(hit["value"], name)).otherwise(value)
        columns[field] = F.when(hit.isNotNull(), F.struct(value.alias("value"), hit["confidence"].alias("confidence"), hit["source"].alias("source")))
    return rows.withColumns(columns) if columns else rows


def corrections(table: DataFrame, doc_type: str, most: int = MOST) -> list[tuple[str, str]]:
    """A kind of document's corrections: its own in their order, then those of all kinds (null doc_type) that it does not have."""
    own = table.filter((F.col("doc_type") == doc_type) | F.col("doc_type").isNull()).dropna(subset=["wrong", "right"])
    own = own.select("wrong", F.col("doc_type").isNull().cast("int").alias("layer"), "place", "right")
    rows = _rows(first_wins(own, ["wrong"], ["layer", "place"]), most)
    return [(r["wrong"], r["right"]) for r in sorted(rows, key=lambda r: (r["layer"], r["place"] or 0, r["wrong"]))]


def settings(table: DataFrame, kind: type[S], most: int = MOST) -> S:
    """A dataclass of defaults with the values that the first layer of a table has; names that it lacks are left out.

    Values are texts: numbers, true and false are read as the default's type, lists at commas. A value of another form is an error.
    """
    rows = _rows(first_wins(table.dropna(subset=["name", "value"]), ["name"], ["layer"]), most)
    given: Mapping[str, str] = {r["name"]: r["value"] for r in rows}
    base = kind()
    return kind(**{f.name: _typed(f.name, given[f.name], getattr(base, f.name)) if f.name in given else getattr(base, f.name) for f in fields(kind)})


def _typed(name: str, value: str, default: object) -> object:
    if isinstance(default, bool):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return value.lower() == "true"
    if isinstance(default, (int, float)):
        return type(default)(value)
    if isinstance(default, (tuple, list)):
        return type(default)(x.strip() for x in value.split(",") if x.strip())
    return value
