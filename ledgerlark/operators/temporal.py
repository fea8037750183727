"""Operators along time: as-of joins, intervals, latest values, running balances, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the latest right values at or before its time.

    Both sides are put together and each left row takes the last value before it, in one shuffle on the
    keys and one sort, however many right rows a key has. No range join, no row twice.
    """
    own = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__value"))
    other = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__value"))
    by = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = own.unionByName(other).withColumn("__value", F.last("__value", ignorenulls=True).over(by)).where("__side = 1")
    return joined.select("__row.*", *[F.col(f"__value.{v}").alias(v) for v in values])


def intervals(edits: DataFrame, keys: list[str], start: str, order: str) -> DataFrame:
    """Half-open validity of edits: of edits on one day the last by order stays, each runs until the next."""
    day = Window.partitionBy(*keys, start).orderBy(F.desc(order))
    kept = edits.withColumn("__n", F.row_number().over(day)).where("__n = 1").drop("__n")
    return kept.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def latest_per_day(rows: DataFrame, keys: list[str], day: str, order: str) -> DataFrame:
    by = Window.partitionBy(*keys, day).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def newest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def running_mismatches(rows: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Printed balances that the rows before don't lead to; the printed one is the new anchor.

    Columns pos, amount_pence, balance_after_pence (null where none is printed).
    """
    by = Window.partitionBy(*keys).orderBy("pos")
    total = F.sum("amount_pence").over(by.rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("__sum", total).withColumn("__anchor", F.when(F.col("balance_after_pence").isNotNull(), F.struct(F.col("balance_after_pence").alias("printed"), F.col("__sum").alias("total"))))
    before = F.last("__anchor", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    checked = summed.withColumn("__before", before).withColumn("expected_pence", F.col("__before.printed") + F.col("__sum") - F.col("__before.total"))
    return checked.where(F.abs(F.col("balance_after_pence") - F.col("expected_pence")) > tolerance).select(*keys, "id", "pos", "balance_after_pence", "expected_pence")


def implied_balances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Opening and closing balance from the first and last printed ones and the rows around them."""
    by = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__sum", F.sum("amount_pence").over(by))
    printed = F.col("balance_after_pence").isNotNull()
    implied = F.col("balance_after_pence") - F.col("__sum")
    grouped = summed.groupBy(*keys).agg(
        F.min_by(implied, F.when(printed, F.col("pos"))).alias("opening_pence"),
        F.max_by(implied, F.when(printed, F.col("pos"))).alias("__last"),
        F.sum("amount_pence").alias("__total"),
        F.count("*").alias("n"),
    )
    return grouped.select(*keys, "opening_pence", (F.col("__last") + F.col("__total")).alias("closing_pence"), "n")


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as (first, last)."""
    by = Window.partitionBy(*keys).orderBy(number)
    return rows.withColumn("__island", F.col(number) - F.row_number().over(by)).groupBy(*keys, "__island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__island")


def gaps(rows: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(day, "id")
    return rows.withColumn("gap_days", F.datediff(day, F.lag(day).over(by)))
