"""Files of several folders as pages, by their format: found on metadata, read where Spark reads them, an error row for what can't be."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecon.operators.store import written

# Suffixes by kind of file, sub-folders that are searched after the folder itself, and a lock file's prefix.
DOCUMENTS = ("pdf",)
IMAGES = ("png", "jpg", "jpeg")
SUBFOLDERS = ("责催（证据材料）", "notice-evidence")
LOCK = "~$"

#: A reader makes a file's bytes into its pages, in order.
Reader = Callable[[bytes], Sequence[str | None]]
PAGES = "file string, path string, page int, text string, method string, error string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, root: str, subfolders: Sequence[str] = SUBFOLDERS) -> list[str]:
    """The folders to search: the root, then those of its known sub-folders that are there."""
    return [root, *[p for p in (f"{root.rstrip('/')}/{s}" for s in subfolders) if exists(spark, p)]]


def _named(df: DataFrame) -> DataFrame:
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return df.withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def _each(spark: SparkSession, where: Sequence[str], *columns: str) -> DataFrame:
    found = None
    for i, folder in enumerate(where):
        files = spark.read.format("binaryFile").load(folder).select("path", *columns).withColumn("folder", F.lit(i))
        found = files if found is None else found.unionByName(files)
    if found is None:
        raise ValueError("no folder to search")
    return _named(found)


def listed(spark: SparkSession, where: Sequence[str], suffixes: Sequence[str] = DOCUMENTS, skip: Sequence[str] = ()) -> DataFrame:
    """Files of these suffixes (none: all) without their contents: path, name, suffix, folder, length, modificationTime, cache_key.

    Of equal names that of the first folder stays, there the first path. skip: names of source tables that lie beside
    the files. Lock files of a spreadsheet are left out, and so are files of no bytes, which Spark's reader does not list.
    """
    files = _each(spark, where, "length", "modificationTime")
    files = files.filter(~F.startswith("name", F.lit(LOCK)))
    if suffixes:
        files = files.filter(F.col("suffix").isin(*suffixes))
    if skip:
        files = files.filter(~F.col("name").isin(*skip))
    first = files.groupBy("name").agg(F.min(F.struct("folder", "path", "suffix", "length", "modificationTime")).alias("f")).select("name", "f.*")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return first.withColumn("cache_key", F.concat_ws("|", stem, F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")))


def _pages(layers: Mapping[str, Reader], others: Mapping[str, Reader], least: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, name, suffix, content in zip(batch["path"], batch["name"], batch["suffix"], batch["content"], strict=True):
                if suffix not in layers and suffix not in others:
                    out.append((name, path, None, None, None, f"unsupported: {suffix}"))
                    continue
                try:
                    layer = list(layers[suffix](content)) if suffix in layers else []
                    short = [i for i, t in enumerate(layer) if len((t or "").strip()) < least]
                    seen = list(others[suffix](content)) if suffix in others and (short or not layer) else []
                    for i in range(max(len(layer), len(seen))):
                        by_layer = i < len(layer) and (i not in short or i >= len(seen))
                        out.append((name, path, i + 1, layer[i] if by_layer else seen[i], "layer" if by_layer else "read", None))
                    if not layer and not seen:
                        out.append((name, path, None, None, None, "no pages"))
                except Exception as e:  # a broken file is a row of the result, not the end of the job
                    out.append((name, path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", "path", "page", "text", "method", "error"]).astype({"page": "Int32"})

    return read


def scanned(spark: SparkSession, where: Sequence[str], layers: Mapping[str, Reader], others: Mapping[str, Reader], suffixes: Sequence[str] = (), skip: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Pages of the files of listed(): file, path, page (from 1), text, method (layer or read), error.

    layers and others: readers by suffix. A file's text layer is read first; the other reader is called only if a page of
    it has under least characters, or there is no layer, and gives those pages. A file of another suffix, without pages,
    or whose reader fails, is one row with an error. A file is read where its bytes are: only paths are shuffled, as long as the paths of files that lose by
    name stay under Spark's broadcast limit.
    """
    every = _each(spark, where)
    lost = written(every.select("path").join(listed(spark, where, suffixes, skip).select("path"), "path", "left_anti"))
    whole = _each(spark, where, "content").join(lost, "path", "left_anti")
    return whole.select("path", "name", "suffix", "content").mapInPandas(_pages(dict(layers), dict(others), least), PAGES)


def first_existing(spark: SparkSession, candidates: Sequence[str], beside: str = "xlsx") -> str:
    """The first candidate that is there; for each that is not, the first file by name beside it with that suffix. An error without any."""
    for path in candidates:
        if exists(spark, path):
            return path
        folder = path.rsplit("/", 1)[0] if "/" in path else "."
        if exists(spark, folder):
            near = spark.read.format("binaryFile").load(folder).select("path")
            near = _named(near).filter((F.col("suffix") == beside) & ~F.startswith("name", F.lit(LOCK))).agg(F.min(F.struct("name", "path"))["path"].alias("path")).first()
            if near["path"]:
                return near["path"]
    raise FileNotFoundError(f"none of these is there: {list(candidates)}")
