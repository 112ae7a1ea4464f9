"""Results that several later joins read, written once to the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a table: later joins scan it instead of working it out anew, and a lost executor costs no recomputation.

    Where the setting is unset, a local master (as in tests) gets a temporary folder; a cluster gets an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, as a side of a join that is not to be broadcast.

    Spark's estimate of a table's size goes by its files and columns: exploded rows, texts made from keys and packed
    Parquet are far larger than that, and a broadcast of them passes through the driver's memory.
    """
    return df.hint("merge")
