"""Tables written to the shared checkpoint folder, to cut lineage and to share a result between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task writes at least, where a bound on a table's rows is known, and the tasks that even a small one gets.
TASK_ROWS, LEAST_TASKS = 1 << 16, 24
#: This process's tables are in one folder below the shared one.
RUN = f"run-{uuid.uuid4().hex}"


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. On a local master (tests) a temporary one is set where it is unset."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def broadcast_if_small(df: DataFrame, rows: int = 50_000, width: Column | None = None, most_bytes: int = 16 << 20) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows and, by width (the bytes of a row's strings), bytes; else a join shuffles it."""
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most_bytes else df


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder as Parquet and read it back.

    rows, where known, bounds its rows (or, with heavier rows, the work in units of one): partitions of a last shuffle
    that would be nearly empty are then taken together, so that a small table of a loop is not hundreds of tasks and files.

    Later jobs read the files, so a lost executor never recomputes what came before, and a join over the
    result is a join over a scan, which adaptive execution can broadcast (by measured size) or split (by skew).
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{RUN}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, rows // TASK_ROWS))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this process has written with table(). Results that still read it must have been written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
