"""The task store as a stateful stream: status, attempts and early stops that survive a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for states of one value a task.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_COLUMNS = ["task", "attempts", "status", "error", "last"]
_OUT = "task string, attempts long, status string, error string, last long, at long"
_STATE = "attempts long, status string, error string, last long"


class TaskStatus(StatefulProcessor):
    """One value a task: attempts, status, error and the number of the last result that was counted.

    A result is counted once: one whose number is not above the last one is a repetition. A task that is done or failed too
    often stays so. After a failure the task is to be retried; with a delay it is so once the delay has passed, until then it waits.
    """

    def __init__(self, most: int, delay_ms: int = 0):
        self.most, self.delay_ms = most, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, status, error, last = self.state.get() if self.state.exists() else (0, "pending", "", -1)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = last
        for seq, ok, said in zip(batch["seq"], batch["ok"], batch["error"], strict=True):
            if seq <= last or status in ("done", "permanent"):
                continue
            attempts, last = attempts + 1, int(seq)
            error = "" if ok else str(said or "")
            status = "done" if ok else "permanent" if attempts > self.most else "waiting" if self.delay_ms else "retry"
        self.state.update((attempts, status, error, last))
        if status == "waiting" and last > before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
        yield self._row(key, attempts, status, error, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, status, error, last = self.state.get()
        if status == "waiting":
            self.state.update((attempts, "retry", error, last))
            yield self._row(key, attempts, "retry", error, last)

    def _row(self, key, attempts, status, error, last) -> pd.DataFrame:
        at = 2 * last + (status == "retry" and self.delay_ms > 0)  # a retry that is due comes after the wait
        return pd.DataFrame({"task": [key[0]], "attempts": [attempts], "status": [status], "error": [error], "last": [last], "at": [at]})

    def close(self) -> None:
        pass


def statuses(results: DataFrame, most: int, delay_ms: int = 0) -> DataFrame:
    """A stream of results (task, seq, ok, error) as a stream of statuses (task, attempts, status, error, last, at), one a task and micro-batch.

    seq numbers a task's results in their order. at orders a task's rows: the greatest is its status, so a sink that keeps
    that row has each task's status whatever was written twice. Needs the state store of PROVIDER.
    """
    slim = results.select(F.col("task").cast("string").alias("task"), F.col("seq").cast("long").alias("seq"), "ok", F.coalesce("error", F.lit("")).alias("error"))
    return slim.groupBy("task").transformWithStateInPandas(TaskStatus(most, delay_ms), _OUT, "Update", "ProcessingTime" if delay_ms else "None")


def counted(results: DataFrame, most: int) -> DataFrame:
    """The same over a table, at once: what a stream of the same results ends with, timers aside.

    The attempts that count are those up to the first success, most + 1 at most; a repeated number counts once, as a
    success if it is one. Only the first most + 1 failures of a task are sorted and brought together, before the shuffle too.
    """
    once = results.groupBy("task", F.col("seq").cast("long").alias("seq")).agg(F.max_by(F.struct("ok", F.coalesce("error", F.lit("")).alias("error")), F.col("ok").cast("int")).alias("r"))
    won = once.groupBy("task").agg(F.min(F.when(F.col("r.ok"), F.col("seq"))).alias("won"))
    failed = once.filter("not r.ok").withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("seq"))).filter(F.col("n") <= most + 1)
    failed = failed.groupBy(F.col("task").alias("_task")).agg(F.array_sort(F.collect_list(F.struct("seq", "r.error"))).alias("failed"))
    first = won.join(failed, F.col("task") == F.col("_task"), "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<struct<seq: bigint, error: string>>")))
    lost = F.filter("failed", lambda x: F.col("won").isNull() | (x["seq"] < F.col("won")))
    gone = F.size(lost) > most
    end = F.try_element_at(lost, F.lit(-1))
    return first.select(
        F.col("task").cast("string").alias("task"), (F.size(lost) + F.when(~gone & F.col("won").isNotNull(), 1).otherwise(0)).cast("long").alias("attempts"),
        F.when(gone, "permanent").when(F.col("won").isNotNull(), "done").otherwise("retry").alias("status"), F.when(~gone & F.col("won").isNotNull(), "").otherwise(end["error"]).alias("error"),
        F.when(~gone & F.col("won").isNotNull(), F.col("won")).otherwise(end["seq"]).alias("last"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """Of everything that a stream of statuses has written, each task's last: (task, attempts, status, error, last)."""
    return rows.groupBy("task").agg(F.max_by(F.struct("attempts", "status", "error", "last"), "at").alias("r")).select("task", "r.*")


class EarlyStop(StatefulProcessor):
    """One value a file: the first page with a hit so far. Pages after it are skipped, whichever micro-batch they come in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hit", "page long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hit = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("page", kind="stable")
        said = []
        for page, found in zip(batch["page"], batch["hit"], strict=True):
            read = hit is None or page <= hit
            if read and found:
                hit = int(page)
            said.append("hit" if read and found else "read" if read else "skipped")
        if hit is not None:
            self.state.update((hit,))
        yield pd.DataFrame({"file": [key[0]] * len(batch), "page": batch["page"].to_numpy(), "status": said})

    def close(self) -> None:
        pass


def stop_early(pages: DataFrame) -> DataFrame:
    """A stream of pages (file, page, hit) in page order as a stream of (file, page, status): hit, read or skipped."""
    slim = pages.select(F.col("file").cast("string").alias("file"), F.col("page").cast("long").alias("page"), "hit")
    return slim.groupBy("file").transformWithStateInPandas(EarlyStop(), "file string, page long, status string", "Update", "None")
