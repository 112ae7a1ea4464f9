"""Streams whose rules may change while they run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sparkrecon.operators import layers
from sparkrecon.streaming import queue


def run_with_rules(events: DataFrame, text: str, rules: Callable[[], DataFrame], out: str, checkpoint: str):
    """Extraction over a stream: rules gives the layers' table, and is asked anew for each micro-batch.

    So a rule that changes shows in the next batch, and a batch that is repeated after a failure takes the rules of the
    repetition. Batches are written under their numbers, as queue.run_available does.
    """
    return queue.run_available(events, out, checkpoint, lambda batch: layers.extracted(batch, text, rules()))
