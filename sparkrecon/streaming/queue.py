"""The task queue: states and retries of tasks, and event-time windows, the same over tables and over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecon.operators.outputs import numbered
from sparkrecon.operators.store import written


def states(attempts: DataFrame, task: str, order: str, result: str, failed: str, done: str, most: int) -> DataFrame:
    """Each task's attempts, last result and state: done, retry, permanent (failed over most times) or pending."""
    last = attempts.groupBy(task).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(result, order).alias("last"))
    state = F.when((F.col("last") == failed) & (F.col("attempts") > most), "permanent").when(F.col("last") == failed, "retry").when(F.col("last") == done, "done").otherwise("pending")
    return last.withColumn("state", state)


def pending(states: DataFrame, created: str, task: str, batch: int) -> DataFrame:
    """The next batch: what is pending or to be retried, oldest first."""
    return states.filter(F.col("state").isin("pending", "retry")).orderBy(created, task).limit(batch)


def timed(events: DataFrame, ts: str, late: str | None = None) -> DataFrame:
    """Event time as a timestamp of the session's zone, with a watermark on a stream."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, ts: str, width: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    counted = timed(events, ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    counted = timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def run_available(events: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame], DataFrame]):
    """Process what a stream has and end. The checkpoint remembers what is done, so a rerun does the rest only.

    Each micro-batch is written under its number: a batch that is repeated after a failure overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint(files: DataFrame) -> str:
    """What a run's input is known by: names, sizes and times of its files. Another input has another checkpoint folder."""
    parts = files.select(F.xxhash64("name", "cache_key").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1000003).alias("s")).first()
    return f"{parts['n']:x}-{(parts['x'] or 0) & 0xFFFFFFFFFFFFFFFF:x}-{(parts['s'] or 0) & 0xFFFFFFFFFFFFFFFF:x}"


def tasks(sources: DataFrame, order: Sequence[Column], first_no: int = 1) -> DataFrame:
    """A pending task for each file of each kind of document (doc_type, file): id, created (its place in order, which should be total), attempts and state."""
    rows = numbered(sources, order, "created")
    return rows.select(F.concat_ws("|", "doc_type", "file").alias("task"), "doc_type", "file", (F.col("created") + first_no - 1).alias("created"), F.lit(0).alias("attempts"), F.lit("pending").alias("state"))


def progress(states: DataFrame) -> DataFrame:
    """One row: tasks, how many of each state, and the share that is done or given up."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.agg(
        F.count(F.lit(1)).alias("total"), n("done").alias("done"), n("retry").alias("retry"), n("permanent").alias("permanent"), n("pending").alias("pending"),
        F.coalesce(F.try_divide(n("done") + n("permanent"), F.count(F.lit(1))), F.lit(0.0)).alias("progress"),
    )


def back_filled(names: DataFrame, results: DataFrame, key: str, order: str, window: int = 1) -> DataFrame:
    """All names with their result's status and error; those that a run that ends with its balance has not asked for are failed.

    names (key, order, ...): the order in which they are asked for, unique; results (key, status, error), a row a key, error
    depleted where the balance had run out. Names are asked for in a sliding window: when the first depleted answer comes,
    the window - 1 names after it are under way, and keep what came of them. Later ones, and those without a result, are
    failed (not queried). Places are numbered over ranges of the order, and the cut is a minimum over them: no task sees all.
    """
    placed = numbered(names, [F.col(order)], "_place")
    joined = written(placed.join(results.select(F.col(key).alias("_key"), "status", "error"), F.col(key) == F.col("_key"), "left"))
    cut = joined.agg(F.min(F.when(F.col("error") == "depleted", F.col("_place")))).first()[0]
    asked = F.col("status").isNotNull() & (F.lit(True) if cut is None else F.col("_place") < cut + window)
    return joined.select(*names.columns, F.when(asked, F.col("status")).otherwise("failed").alias("status"), F.when(asked, F.col("error")).otherwise("not queried").alias("error"))
