"""The folder that driver and executors share, and tables written there: short lineage that outlives executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

#: Folders that cut() wrote in this session and that scratch() hasn't removed.
_CUTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine a folder of our own will do where none is set; on a cluster it wouldn't."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever it lies."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a table whose writing came to its end."""
    files, at = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end the folders go that cut() wrote inside; what is still needed must have been written elsewhere by then."""
    held = len(_CUTS)
    yield
    for path in _CUTS[held:]:
        removed(spark, path)
    del _CUTS[held:]


def in_parts(rows: Iterable, most: int) -> Iterator[list]:
    """rows in lists of at most so many, none of them empty."""
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield part


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys (or evenly) to as many tasks as the session has shuffle partitions, however few bytes it has.

    For rows that take much time or memory for their bytes: by bytes alone, few tasks would get them all.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt_by_rows(df: DataFrame, rows: int, most: int, *keys: str) -> DataFrame:
    """df dealt out by keys to tasks of about most of its rows, but to as many tasks as there are cores at least.

    For rows that take little when they're shuffled and much when they're sorted: by bytes, a task would get too many.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)
