"""Streams over the driver's events: a run over all that is there equals the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks
from ..streaming import arrivals as A
from .adapter import MOVEMENT, table, with_sql
from .registry import query


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return A.arrivals(spark, path, spark.read.parquet(path).schema).withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) > 0 AS seen FROM events GROUP BY 1, 2, 3")
def ST4_distinct_arrivals(spark, sf_dir):
    stream = _events(spark, sf_dir).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return A.run_available(A.without_duplicates(stream, ["user_id", "event_type", "day"], "at")).select("user_id", "event_type", "day", F.lit(True).alias("seen"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n, count(*) > 1 AS merged FROM s GROUP BY user_id, k""")
def ST1_coalesced_requests(spark, sf_dir):
    batch = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return A.coalesced(batch, ["user_id"], "at", "1 hour").select("user_id", "n", (F.col("n") > 1).alias("merged"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def ST1_closed_requests(spark, sf_dir):
    """The same as a stream: requests that the watermark has passed are told, the last ones still wait for more."""
    return A.run_available(A.coalesced(_events(spark, sf_dir), ["user_id"], "at", "1 hour")).select("user_id", "n")


@query(with_sql(MOVEMENT, "t AS (SELECT m.*, e.ts FROM movement m JOIN events e ON m.id = e.event_id)") + "SELECT o.id AS out_id, i.id AS in_id, -o.amount_pence AS size FROM t o JOIN t i ON o.amount_pence < 0 AND i.amount_pence = -o.amount_pence AND o.account_id <> i.account_id AND i.ts BETWEEN o.ts - INTERVAL 3 DAY AND o.ts + INTERVAL 3 DAY")
def ST5_late_halves(spark, sf_dir):
    half = lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), "at", F.round(F.col("value") * 100).cast("bigint").alias("size")).where("size <> 0")
    return A.run_available(A.late_halves(half("purchase"), half("signup"))).select("out_id", "in_id", F.col("out_size").alias("size"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS covered_to, count(*) AS n FROM events GROUP BY 1")
def ST3_incremental_coverage(spark, sf_dir):
    """Coverage kept by snapshots: each batch of arrivals touches its own accounts only, and a batch run twice counts once."""
    at = A.folder(spark)

    def work(batch, number):
        sums = batch.groupBy("user_id").agg(F.max("at").alias("covered_to"), F.count("*").alias("n"))
        sinks.snapshot(sums, at, number)

    A.for_each_batch(_events(spark, sf_dir), work)
    kept = spark.read.schema("user_id bigint, covered_to timestamp, n bigint").parquet(f"{at}/version=*")
    return kept.groupBy("user_id").agg(F.date_format(F.max("covered_to"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("covered_to"), F.sum("n").alias("n"))


@query("SELECT user_id, max(ts) AS covered_to, count(*) AS n FROM events GROUP BY 1")
def ST6_coverage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("covered_to"), F.count("*").alias("n"))
