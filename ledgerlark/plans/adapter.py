"""The driver tables as canonical tables: Spark DataFrames, and the same as DuckDB SQL for the oracle.

- category: regions over nations over market segments, ids as dotted slugs.
- ledger: orders as transactions with their understanding (category, who, status, confidence ...).
- movement: events as transactions of accounts (users), purchases out and sign-ups in.
- statement: months of an account's movements, with opening and closing balances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, level, label, kind: a tree of three levels, small by construction."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    kind = F.when(F.col("r_regionkey") == 3, "income").when(F.col("r_regionkey") == 4, "transfer").otherwise("spend")
    top = region.select(F.lower("r_name").alias("top"), "r_regionkey", F.col("r_name").alias("top_label"), kind.alias("kind"))
    top = top.withColumn("top", F.replace("top", F.lit(" "), F.lit("-")))
    mid = nation.join(top, F.col("n_regionkey") == F.col("r_regionkey")).select("top", "kind", F.col("n_name").alias("label"), F.concat_ws(".", "top", F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).alias("id"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct().withColumn("k", F.lit(1))
    low = mid.withColumn("k", F.lit(1)).join(F.broadcast(segments), "k")
    return (
        top.select(F.col("top").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"), F.col("top_label").alias("label"), "kind")
        .unionByName(mid.select("id", F.col("top").alias("parent_id"), F.lit(2).alias("level"), "label", "kind"))
        .unionByName(low.select(F.concat_ws(".", "id", F.lower("segment")).alias("id"), F.col("id").alias("parent_id"), F.lit(3).alias("level"), F.col("segment").alias("label"), "kind"))
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as understood transactions."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.concat_ws(".", F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).alias("place"),
    )
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(where, "c_nationkey")
    key, pence = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    status = F.when(key % 7 == 0, "unknown").when(key % 5 == 0, "confirmed").when(key % 3 == 0, "low_confidence").otherwise("inferred")
    return own.select(
        key.alias("id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", pence).otherwise(-pence).alias("amount_pence"),
        (F.col("o_custkey") % 97).alias("merchant_id"),
        F.when(key % 11 != 0, F.concat_ws(".", "place", F.lower("c_mktsegment"))).alias("category_id"),
        F.when(key % 4 == 0, F.concat(F.lit("p"), (key % 3).cast("string"))).otherwise("household").alias("who"),
        (key % 97 == 0).alias("ignored"),
        status.alias("status"),
        ((key % 100) / 100.0).cast("double").alias("confidence"),
        F.when(key % 7 == 0, None).when(key % 5 == 0, "human").when(key % 3 == 0, "model").otherwise("rule").alias("decided_by"),
        F.when(key % 7 == 0, 0).when(key % 5 == 0, 100).when(key % 3 == 0, 40).otherwise(80).alias("authority"),
        (key % 13).cast("int").alias("knowledge_version"),
        F.upper("o_orderpriority").alias("text"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as account movements."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    pence = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.when(F.col("user_id") % 10 == 0, "credit_card").otherwise("current").alias("account_kind"),
        F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_type") == "purchase", -pence).otherwise(pence).alias("amount_pence"),
        F.concat(F.when(k % 5 == 0, "TRANSFER TO ").when(k % 7 == 0, "REFUND ").otherwise("SHOP "), F.lit("REF"), k.cast("string")).alias("text"),
    ).where("amount_pence <> 0")


def balances(moves: DataFrame, wrong: int = 500) -> DataFrame:
    """Movements with a printed balance after each, every ninth of them wrong by so many pence, every fourth unprinted."""
    by = Window.partitionBy("account_id").orderBy("date", "id")
    running = F.sum("amount_pence").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 100_000
    printed = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 9 == 0, running + wrong).otherwise(running)
    return moves.withColumn("pos", F.row_number().over(by)).withColumn("balance_after_pence", printed)


CATEGORY = """top AS (SELECT replace(lower(r_name), ' ', '-') AS top, r_regionkey, r_name,
    CASE r_regionkey WHEN 3 THEN 'income' WHEN 4 THEN 'transfer' ELSE 'spend' END AS kind FROM region),
mid AS (SELECT top, kind, n_name AS label, top || '.' || replace(lower(n_name), '_', '-') AS id FROM nation JOIN top ON n_regionkey = r_regionkey),
category AS (SELECT top AS id, CAST(NULL AS VARCHAR) AS parent_id, 1 AS level, r_name AS label, kind FROM top
    UNION ALL SELECT id, top, 2, label, kind FROM mid
    UNION ALL SELECT id || '.' || lower(s), id, 3, s, kind FROM mid, (SELECT DISTINCT c_mktsegment AS s FROM customer))"""

LEDGER = """ledger AS (SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_pence,
    o_custkey % 97 AS merchant_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN replace(lower(r_name), ' ', '-') || '.' || replace(lower(n_name), '_', '-') || '.' || lower(c_mktsegment) END AS category_id,
    CASE WHEN o_orderkey % 4 = 0 THEN 'p' || (o_orderkey % 3) ELSE 'household' END AS who,
    o_orderkey % 97 = 0 AS ignored,
    CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 0 THEN 'low_confidence' ELSE 'inferred' END AS status,
    CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS confidence,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'human' WHEN o_orderkey % 3 = 0 THEN 'model' ELSE 'rule' END AS decided_by,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 100 WHEN o_orderkey % 3 = 0 THEN 40 ELSE 80 END AS authority,
    CAST(o_orderkey % 13 AS INTEGER) AS knowledge_version, upper(o_orderpriority) AS text
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

MOVEMENT = """movement AS (SELECT * FROM (SELECT event_id AS id, user_id AS account_id, CASE WHEN user_id % 10 = 0 THEN 'credit_card' ELSE 'current' END AS account_kind,
    CAST(ts AS DATE) AS date, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS amount_pence,
    CASE WHEN k % 5 = 0 THEN 'TRANSFER TO ' WHEN k % 7 = 0 THEN 'REFUND ' ELSE 'SHOP ' END || 'REF' || k AS text
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('purchase', 'signup'))) WHERE amount_pence <> 0)"""

BALANCED = """balanced AS (SELECT *, row_number() OVER w AS pos,
    CASE WHEN id % 4 = 0 THEN NULL WHEN id % 9 = 0 THEN 500 ELSE 0 END + 100000 + CAST(sum(amount_pence) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after_pence
    FROM movement WINDOW w AS (PARTITION BY account_id ORDER BY date, id))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
