"""What a run's phases counted, gathered while they ran: no second pass over their rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sparkrecon.operators.store import written


class Run:
    """Phases of a run, each written once, with its rows, seconds and counts of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.phases = spark, name, []

    def phase(self, name: str, rows: DataFrame, **counts: Column) -> DataFrame:
        """rows as a table. counts: aggregates of its columns, numbers, taken by the job that writes it."""
        seen, began = Observation(), time.monotonic()
        table = written(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in counts.items()]))
        found = dict(seen.get)
        self.phases.append((len(self.phases) + 1, name, int(found.pop("rows")), time.monotonic() - began, {k: float(v or 0) for k, v in found.items()}))
        return table

    def summary(self) -> DataFrame:
        """A row a phase in order: run, number, phase, rows, seconds and counts."""
        rows = [(self.name, *p) for p in self.phases]
        return self.spark.createDataFrame(rows, "run string, number int, phase string, rows long, seconds double, counts map<string, double>")

    def total(self) -> DataFrame:
        """One row: phases, seconds, and the slowest phase (the first of two)."""
        slowest = F.min_by("phase", F.struct(-F.col("seconds"), F.col("number")))
        return self.summary().agg(F.count(F.lit(1)).alias("phases"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), slowest.alias("slowest"))


class Notices(StreamingQueryListener):
    """Tells each micro-batch of a session's streams: name, batch, rows read, rows a second, state rows, observed counts.

    tell is called with a dictionary on the driver; start and end of a stream are told, too, an error with its text.
    """

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"event": "started", "name": event.name, "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.tell({
            "event": "progress", "name": p.name, "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "counts": counts,
        })

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"event": "ended", "id": str(event.id), "error": event.exception})
