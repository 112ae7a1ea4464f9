"""Rules, corrections and settings in layers, and a stream whose rules change."""

from dataclasses import dataclass

import pytest

from sparkrecon.operators import layers
from sparkrecon.streaming import configured

RULES = [
    (1, 0, "id", "number", r"(\d+)", 0.9, 1, None),
    (0, 0, "id", "number", r"(\d{3,})", 0.8, 1, None),
    (1, 1, "paid", "sum", r"([\d,]+)元", 1.0, 1, "parse_amount"),
    (1, 2, "judge", "name", r"审判员(\S+)", 1.0, 1, "clean_name"),
    (1, 3, None, "nowhere", "x", 1.0, 1, None),
    (1, 4, "judge", "none", None, 1.0, 1, None),
]


@dataclass
class Reading:
    pages: int = 10
    share: float = 0.02
    stop: bool = False
    regions: tuple = ()
    name: str = "a"


def test_first_layer_wins_and_values_are_post_processed(spark):
    rows = spark.createDataFrame([(1, "12 and 345, 1,200元 审判员王明二〇二五", "old"), (2, None, "old"), (3, "", "old"), (4, "12", "old")], "k int, body string, id string")
    found = {r["k"]: r for r in layers.extracted(rows, "body", spark.createDataFrame(RULES, layers.RULE_ROWS)).collect()}
    assert found[1]["id"].asDict() == {"value": "345", "confidence": 0.8, "source": "number"}
    assert found[1]["paid"]["value"] == "1200" and found[1]["judge"]["value"] == "王明"
    assert all(found[k][c] is None for k in (2, 3, 4) for c in ("id", "paid", "judge"))


def test_no_rules_and_too_many(spark):
    rows = spark.createDataFrame([(1, "x")], "k int, body string")
    assert layers.extracted(rows, "body", spark.createDataFrame([], layers.RULE_ROWS)).columns == ["k", "body"]
    with pytest.raises(ValueError):
        layers.extracted(rows, "body", spark.createDataFrame(RULES, layers.RULE_ROWS), most=1)


def test_own_corrections_come_first(spark):
    table = spark.createDataFrame([("notice", 0, "a", "b"), ("notice", 1, "a", "z"), (None, 0, "a", "c"), (None, 1, "x", "y"), ("other", 0, "q", "r"), (None, 2, None, "r")], layers.CORRECTION_ROWS)
    assert layers.corrections(table, "notice") == [("a", "b"), ("x", "y")]
    assert layers.corrections(table, "unknown") == [("a", "c"), ("x", "y")]


def test_settings_have_defaults_and_types(spark):
    table = spark.createDataFrame([(1, "pages", "4"), (0, "pages", "3"), (1, "stop", "TRUE"), (1, "regions", "top, middle"), (1, "share", "0.5"), (1, "else", "1"), (1, "name", None)], layers.SETTING_ROWS)
    assert layers.settings(table, Reading) == Reading(3, 0.5, True, ("top", "middle"), "a")
    with pytest.raises(ValueError):
        layers.settings(spark.createDataFrame([(0, "stop", "yes")], layers.SETTING_ROWS), Reading)


def test_changed_rule_shows_in_the_next_batch(spark, tmp_path):
    source, asked = str(tmp_path / "in"), []
    for k in (1, 2):
        spark.createDataFrame([(k, "12 and 345")], "k int, body string").coalesce(1).write.mode("append").parquet(source)

    def rules():
        asked.append(1)
        return spark.createDataFrame(RULES[:1] if len(asked) == 1 else RULES[:2], layers.RULE_ROWS)

    events = spark.readStream.schema("k int, body string").option("maxFilesPerTrigger", 1).parquet(source)
    configured.run_with_rules(events, "body", rules, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("batch", "id.value").orderBy("batch").collect()
    assert [tuple(r) for r in rows] == [(0, "12"), (1, "345")] and len(asked) == 2
