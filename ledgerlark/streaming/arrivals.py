"""Operators over arriving rows: duplicates, late halves of transfers, coalesced requests, per-batch runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import shared_dir


def arrivals(spark: SparkSession, path: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file (as its folder, filtered by its name)."""
    reader = spark.readStream.schema(schema)
    first = spark.read.schema(schema).parquet(path).inputFiles()[:1]
    if first and first[0].rstrip("/").endswith(path.rstrip("/").rpartition("/")[2]):
        path, _, name = path.rstrip("/").rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def without_duplicates(stream: DataFrame, keys: list[str], time: str, within: str = "30 days") -> DataFrame:
    """The first arrival of each key; state is kept for as long as a duplicate may come."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def coalesced(stream: DataFrame, keys: list[str], time: str, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Requests of one scope that follow each other within quiet are one: its start, end and number."""
    own = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, quiet).alias("w")).agg(F.count("*").alias("n"))
    return own.select(*keys, F.col("w.start").alias("first_at"), F.col("w.end").alias("run_after"), "n")


def late_halves(out: DataFrame, into: DataFrame, days: int = 3) -> DataFrame:
    """Opposite halves of transfers whichever comes first: a stream-stream join whose band bounds its state.

    Columns id, account_id, at, size on both sides.
    """
    a = out.select(F.col("id").alias("out_id"), F.col("account_id").alias("out_account"), F.col("at").alias("out_at"), F.col("size").alias("out_size")).withWatermark("out_at", f"{days} days")
    b = into.select(F.col("id").alias("in_id"), F.col("account_id").alias("in_account"), F.col("at").alias("in_at"), F.col("size").alias("in_size")).withWatermark("in_at", f"{days} days")
    near = F.col("in_at").between(F.col("out_at") - F.expr(f"interval {days} days"), F.col("out_at") + F.expr(f"interval {days} days"))
    return a.join(b, (F.col("out_size") == F.col("in_size")) & (F.col("out_account") != F.col("in_account")) & near).select("out_id", "in_id", "out_size")


def folder(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that has arrived, written once and read back."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None]) -> None:
    """Run work over each batch of what has arrived; a batch that is run again has its old number."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder(stream.sparkSession)}/checkpoint").trigger(availableNow=True).start().awaitTermination()
