"""Counts of phases and of streams, without a second pass."""

import time

from pyspark.sql import functions as F

from sparkrecon.operators.progress import Notices, Run
from sparkrecon.streaming import queue


def test_phases_count_while_they_run(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        calls.add(1)
        return x

    run = Run(spark, "trial")
    first = run.phase("first", spark.range(100, numPartitions=3).select(seen("id").alias("v")), odd=F.count_if(F.col("v") % 2 == 1))
    run.phase("second", first.filter("v < 10"), most=F.max("v"))
    run.phase("third", first.filter("v < 0"), most=F.max("v"))
    assert calls.value == 100
    rows = run.summary().orderBy("number").collect()
    assert [(r["run"], r["phase"], r["rows"], r["counts"]) for r in rows] == [("trial", "first", 100, {"odd": 50.0}), ("trial", "second", 10, {"most": 9.0}), ("trial", "third", 0, {"most": 0.0})]
    total = run.total().first()
    assert total["phases"] == 3 and total["slowest"] in ("first", "second", "third")
    assert abs(total["seconds"] - sum(r["seconds"] for r in rows)) < 1e-6


def test_no_phases(spark):
    assert Run(spark, "empty").total().first().asDict() == {"phases": 0, "seconds": 0.0, "slowest": None}


def test_streams_tell_their_batches(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    for n in (3, 4):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
    notices = Notices(told.append)
    spark.streams.addListener(notices)
    try:
        events = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        queue.run_available(events, str(tmp_path / "out"), str(tmp_path / "state"), lambda batch: batch).awaitTermination()
        for _ in range(100):
            if any(t["event"] == "ended" for t in told):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(notices)
    rows = [t["rows"] for t in told if t["event"] == "progress" and t["rows"]]
    assert sorted(rows) == [3, 4]
    assert [t["event"] for t in told][0] == "started" and told[-1]["event"] == "ended" and told[-1]["error"] is None
