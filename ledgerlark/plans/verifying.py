"""Checks of statements over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import pounds
from ..operators import verifying as V
from .adapter import BALANCED, MOVEMENT, balances, movements, table, with_sql
from .registry import query


def _unsigned(spark, sf_dir):
    rows = balances(movements(spark, sf_dir), wrong=0)
    return rows.withColumn("unsigned", F.col("id") % 5 == 0).withColumn("amount_pence", F.when(F.col("unsigned"), F.abs("amount_pence")).otherwise(F.col("amount_pence")))


_RIGHT = BALANCED.replace("THEN 500", "THEN 0")
_STRETCH = """st AS (SELECT *, CASE WHEN id % 5 = 0 THEN abs(amount_pence) ELSE amount_pence END AS shown, id % 5 = 0 AS unsigned,
    coalesce(sum(CASE WHEN balance_after_pence IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch,
    last_value(balance_after_pence IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM balanced)"""


@query(with_sql(MOVEMENT, _RIGHT, _STRETCH) + """, g AS (SELECT account_id, stretch, count(*) FILTER (unsigned) AS n, max(balance_after_pence) - min(before) - sum(CASE WHEN unsigned THEN 0 ELSE shown END) AS gap FROM st GROUP BY 1, 2)
    SELECT id, CASE WHEN unsigned AND n = 1 AND gap = -shown THEN -shown ELSE shown END AS amount_pence FROM st JOIN g USING (account_id, stretch)""")
def WN14_sign_repair(spark, sf_dir):
    return V.repaired_signs(_unsigned(spark, sf_dir), ["account_id"]).select("id", "amount_pence")


@query(with_sql(MOVEMENT, _RIGHT, _STRETCH).replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT account_id, stretch, min(before) AS before, max(balance_after_pence) AS after, count(*) FILTER (unsigned) AS n, sum(CASE WHEN unsigned THEN 0 ELSE shown END) AS fixed FROM st GROUP BY 1, 2),
    u AS (SELECT account_id, stretch, shown, row_number() OVER (PARTITION BY account_id, stretch ORDER BY pos) AS i FROM st WHERE unsigned),
    r AS (SELECT account_id, stretch, 0 AS i, after - before - fixed AS rest FROM g WHERE before IS NOT NULL AND after IS NOT NULL AND n BETWEEN 1 AND 16 UNION ALL SELECT r.account_id, r.stretch, r.i + 1, r.rest + s * u.shown FROM r JOIN u ON u.account_id = r.account_id AND u.stretch = r.stretch AND u.i = r.i + 1, (VALUES (1), (-1)) v(s))
    SELECT g.account_id, g.stretch, CAST(n AS INTEGER) AS n_unsigned, CASE WHEN n <= 16 THEN CAST(least(2, (SELECT count(*) FROM r WHERE r.account_id = g.account_id AND r.stretch = g.stretch AND r.i = g.n AND abs(r.rest) <= 1)) AS INTEGER) END AS ways FROM g WHERE before IS NOT NULL AND after IS NOT NULL AND n > 0""")
def WN14_sign_ways(spark, sf_dir):
    return V.ways(_unsigned(spark, sf_dir), ["account_id"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 WHEN p_partkey % 3 = 1 THEN 1 END AS sign FROM part")
def B7_label_sign(spark, sf_dir):
    line = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " Paid Out").when(F.col("p_partkey") % 3 == 1, " CR in").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", V.sign_label(line).alias("sign"))


@query(with_sql(MOVEMENT, BALANCED) + """, x AS (SELECT *, sum(amount_pence) OVER (PARTITION BY account_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM balanced),
    y AS (SELECT *, last_value(balance_after_pence - s IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM x),
    t AS (SELECT account_id, CAST(sum(amount_pence) AS BIGINT) AS total FROM movement GROUP BY 1),
    c AS (SELECT account_id, id AS ref, 'not printed' AS code FROM x WHERE id % 10 = 0 UNION ALL SELECT account_id, id, 'sign' FROM x WHERE id % 7 = 0 AND id % 10 <> 0 AND amount_pence > 0 UNION ALL SELECT account_id, id, 'balance' FROM y WHERE abs(balance_after_pence - (base + s)) > 1
        UNION ALL SELECT account_id, NULL, 'closing' FROM t WHERE account_id % 3 = 0 UNION ALL SELECT account_id, NULL, 'rows' FROM t WHERE account_id % 4 = 0 UNION ALL SELECT -1, NULL, 'no rows')
    SELECT account_id, ref, code FROM c""")
def D12_verify_rows(spark, sf_dir):
    """Lines print the amount, some of them another one or a minus too many; some balances, closings and accounts are off."""
    rows, k = balances(movements(spark, sf_dir)), F.col("account_id")
    shown = F.when(F.col("id") % 10 == 0, "none").when(F.col("id") % 7 == 0, F.concat(F.lit("-"), pounds(F.abs("amount_pence")))).otherwise(pounds(F.col("amount_pence")))
    read = rows.select("account_id", F.col("id").alias("ref"), "pos", F.concat(F.lit("line "), shown).alias("text"), "amount_pence", "balance_after_pence", F.lit(False).alias("unsigned"))
    totals = movements(spark, sf_dir).groupBy("account_id").agg(F.sum("amount_pence").alias("total"))
    said = totals.select("account_id", F.lit(100).alias("opening_pence"), (F.col("total") + 100 + F.when(k % 3 == 0, 50).otherwise(1)).alias("closing_pence"), F.when(k % 4 == 0, "rows").alias("doubt"))
    empty = totals.agg(F.lit(-1).cast("bigint").alias("account_id")).select("account_id", F.lit(0).alias("opening_pence"), F.lit(0).cast("bigint").alias("closing_pence"), F.lit(None).cast("string").alias("doubt"))
    return V.verified(read, said.unionByName(empty), "account_id")


@query(with_sql(MOVEMENT) + """, l AS (SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY date, id) AS pos FROM movement),
    r AS (SELECT account_id, 'L' || pos AS ref FROM l WHERE pos % 7 NOT IN (3, 4) UNION ALL SELECT account_id, 'L' || pos || '#fee' FROM l WHERE pos % 5 = 0 UNION ALL SELECT account_id, 'L' || pos FROM l WHERE pos % 11 = 0 AND pos % 7 NOT IN (3, 4) UNION ALL SELECT account_id, 'X' || pos FROM l WHERE pos % 13 = 0),
    n AS (SELECT account_id, ref, count(*) AS n FROM r GROUP BY 1, 2),
    m AS (SELECT account_id, pos, pos - row_number() OVER (PARTITION BY account_id ORDER BY pos) AS run FROM l WHERE pos % 7 IN (3, 4) AND pos % 5 <> 0 AND pos % 17 <> 0),
    g AS (SELECT account_id, min(pos) AS a, max(pos) AS b FROM m GROUP BY account_id, run)
    SELECT account_id, ref, 'duplicate' AS code, NULL AS refs FROM n WHERE n > 1
    UNION ALL SELECT account_id, ref, 'unexpected', NULL FROM n WHERE ref LIKE 'X%'
    UNION ALL SELECT account_id, ref, 'header', NULL FROM n WHERE ref LIKE 'L%' AND CAST(regexp_extract(ref, '[0-9]+') AS BIGINT) % 17 = 0
    UNION ALL SELECT account_id, NULL, 'missing', string_agg('L' || a || CASE WHEN b > a THEN '-L' || b ELSE '' END, ', ' ORDER BY a) FROM g GROUP BY account_id""")
def D12_line_coverage(spark, sf_dir):
    """Two lines of seven are read by none, some of them by their fee alone; some are read twice, or aren't there, or are headings."""
    by = Window.partitionBy("account_id").orderBy("date", "id")
    own = movements(spark, sf_dir).select("account_id", F.row_number().over(by).alias("pos"))
    ref, pos = F.concat(F.lit("L"), "pos"), F.col("pos")
    read = ~(pos % 7).isin(3, 4)
    rows = own.select("account_id", F.explode(F.array_compact(F.array(F.when(read, ref), F.when(pos % 5 == 0, F.concat(ref, F.lit("#fee"))), F.when(read & (pos % 11 == 0), ref), F.when(pos % 13 == 0, F.concat(F.lit("X"), pos))))).alias("ref"))
    return V.line_coverage(rows, own.select("account_id", ref.alias("ref"), (pos % 17 != 0).alias("is_data")), "account_id")


@query(with_sql(MOVEMENT) + """, s AS (SELECT account_id, min(date) AS lo, max(date) AS hi FROM movement GROUP BY 1),
    p AS (SELECT account_id, CASE WHEN account_id % 7 <> 1 THEN lo + 5 END AS a, CASE account_id % 7 WHEN 2 THEN NULL WHEN 3 THEN lo WHEN 4 THEN lo + 500 ELSE hi END AS b FROM s)
    SELECT account_id, m.id AS ref, 'outside' AS code FROM movement m JOIN p USING (account_id) WHERE a IS NOT NULL AND b IS NOT NULL AND b >= a AND b - a <= 400 AND NOT date BETWEEN a - 3 AND b + 3
    UNION ALL SELECT account_id, id, 'zero' FROM movement WHERE id % 9 = 0 UNION ALL SELECT account_id, id, 'too large' FROM movement WHERE id % 9 = 1
    UNION ALL SELECT account_id, NULL, 'no start' FROM p WHERE a IS NULL UNION ALL SELECT account_id, NULL, 'no end' FROM p WHERE b IS NULL
    UNION ALL SELECT account_id, NULL, CASE WHEN b < a THEN 'reversed' ELSE 'too long' END FROM p WHERE b < a OR b - a > 400""")
def D12_periods(spark, sf_dir):
    own, k = movements(spark, sf_dir), F.col("account_id") % 7
    span = own.groupBy("account_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    end = F.when(k == 2, None).when(k == 3, F.col("lo")).when(k == 4, F.date_add("lo", 500)).otherwise(F.col("hi"))
    statements = span.select("account_id", F.when(k != 1, F.date_add("lo", 5)).alias("period_start"), end.alias("period_end"))
    rows = own.select("account_id", F.col("id").alias("ref"), "date", F.when(F.col("id") % 9 == 0, 0).when(F.col("id") % 9 == 1, -(V.MOST_PENCE + 1)).otherwise(F.col("amount_pence")).alias("amount_pence"))
    return V.period_codes(rows, statements, "account_id")
