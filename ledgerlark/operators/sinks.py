"""Writing: snapshots that replace each other whole, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import pounds


def snapshot(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """Write a version of a table to a folder of its own and return the folder; a failed write leaves the one before."""
    path = f"{root.rstrip('/')}/version={version:010d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


#: Rows of one exported file.
MOST_ROWS = 5_000


def export_csv(rows: DataFrame, path: str, most: int = MOST_ROWS) -> None:
    """Transactions as a signed delimited export with headings, in files of at most so many rows, as a reader takes a file whole."""
    shown = rows.select(
        F.date_format("date", "dd/MM/yyyy").alias("Date"), F.col("description").alias("Counter Party"), F.lit("").alias("Reference"), F.lit("CARD").alias("Type"),
        pounds(F.col("amount_pence")).alias("Amount (GBP)"), F.lit("").alias("Balance (GBP)"), F.lit("").alias("Spending Category"),
    )
    shown.write.mode("overwrite").option("maxRecordsPerFile", most).option("header", "true").option("quoteAll", "true").option("escape", "\"").csv(path)
