"""Spending, balances, usage and other reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens_estimate
from ..operators import spending, temporal
from .adapter import BALANCED, CATEGORY, LEDGER, MOVEMENT, balances, categories, ledger, movements, table, with_sql
from .registry import query

PERIOD = ("1997-01-01", "1998-12-31")
_IN_PERIOD = "date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND NOT ignored"
_TOTALS = f"totals AS (SELECT category_id, CAST(sum(amount_pence) AS BIGINT) AS net_pence, count(*) AS n, CAST(-sum(least(amount_pence, 0)) AS BIGINT) AS out_pence FROM ledger WHERE {_IN_PERIOD} GROUP BY category_id)"


def period_rows(spark, sf_dir):
    return ledger(spark, sf_dir).where(spending.spending_filter(*PERIOD))


@query(with_sql(LEDGER, _TOTALS) + "SELECT * FROM totals")
def A1_category_totals(spark, sf_dir):
    return spending.category_totals(period_rows(spark, sf_dir))


@query(with_sql(LEDGER, CATEGORY, _TOTALS) + f"""SELECT tile, CAST(-sum(net_pence) AS BIGINT) AS amount_pence, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT split_part(category_id, '.', 1) AS tile, net_pence, n FROM totals JOIN category ON category_id = id WHERE kind = 'spend'
    UNION ALL SELECT 'unsorted', sum(amount_pence), count(*) FROM ledger WHERE {_IN_PERIOD} AND category_id IS NULL AND amount_pence < 0) GROUP BY tile HAVING -sum(net_pence) > 0""")
def A2_breakdown_root(spark, sf_dir):
    return spending.breakdown(period_rows(spark, sf_dir), categories(spark, sf_dir))


@query(with_sql(LEDGER, CATEGORY, _TOTALS) + """SELECT array_to_string(string_split(category_id, '.')[1:2], '.') AS tile, CAST(-sum(net_pence) AS BIGINT) AS amount_pence, CAST(sum(n) AS BIGINT) AS n
    FROM totals JOIN category ON category_id = id WHERE kind = 'spend' AND category_id LIKE 'asia.%' GROUP BY 1 HAVING -sum(net_pence) > 0""")
def A2_breakdown_drill(spark, sf_dir):
    return spending.breakdown(period_rows(spark, sf_dir), categories(spark, sf_dir), "asia")


@query(with_sql(LEDGER, _TOTALS) + """SELECT array_to_string(string_split(category_id, '.')[1:k], '.') AS ancestor_id, CAST(sum(net_pence) AS BIGINT) AS net_pence, CAST(sum(n) AS BIGINT) AS n
    FROM totals, (SELECT unnest([1, 2, 3]) AS k) WHERE category_id IS NOT NULL GROUP BY 1""")
def A2_tree_totals(spark, sf_dir):
    return spending.tree_totals(period_rows(spark, sf_dir), categories(spark, sf_dir))


@query(with_sql(LEDGER, CATEGORY, _TOTALS) + """SELECT CAST(coalesce(sum(net_pence) FILTER (kind = 'income'), 0) AS BIGINT) AS in_pence,
    CAST(coalesce(-sum(net_pence) FILTER (id = 'middle-east' OR id LIKE 'middle-east.%'), 0) AS BIGINT) AS saved_pence,
    CAST(coalesce(-sum(net_pence) FILTER (kind = 'transfer' AND NOT (id LIKE 'middle-east.%')), 0) AS BIGINT) AS moved_pence
    FROM totals JOIN category ON category_id = id""")
def A3_side_totals(spark, sf_dir):
    return spending.side_totals(period_rows(spark, sf_dir), categories(spark, sf_dir), "middle-east")


@query(with_sql(LEDGER) + f"SELECT CAST(coalesce(-sum(amount_pence), 0) AS BIGINT) AS amount_pence, count(*) AS n FROM ledger WHERE {_IN_PERIOD} AND category_id IS NULL AND amount_pence < 0")
def A4_unsorted(spark, sf_dir):
    return period_rows(spark, sf_dir).where("category_id IS NULL AND amount_pence < 0").agg(F.coalesce(-F.sum("amount_pence"), F.lit(0)).cast("bigint").alias("amount_pence"), F.count("*").alias("n"))


@query(with_sql(LEDGER) + "SELECT category_id, count(*) AS n, count(DISTINCT merchant_id) AS merchants FROM ledger WHERE category_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 40 AND count(DISTINCT merchant_id) >= 4")
def A8_crowded_categories(spark, sf_dir):
    return ledger(spark, sf_dir).where("category_id IS NOT NULL").groupBy("category_id").agg(F.count("*").alias("n"), F.countDistinct("merchant_id").alias("merchants")).where("n >= 40 AND merchants >= 4")


@query(with_sql(LEDGER) + "SELECT merchant_id, count(*) AS n, CAST(sum(abs(amount_pence)) AS BIGINT) AS pence FROM ledger WHERE category_id LIKE 'asia.%' GROUP BY 1 ORDER BY pence DESC, merchant_id LIMIT 60")
def A9_category_merchants(spark, sf_dir):
    return ledger(spark, sf_dir).where(spending.in_subtree("category_id", "asia")).groupBy("merchant_id").agg(F.count("*").alias("n"), F.sum(F.abs("amount_pence")).alias("pence")).orderBy(F.desc("pence"), "merchant_id").limit(60)


@query(with_sql(MOVEMENT) + """SELECT account_id, greatest(max(date), max(last_day(date)) FILTER (amount_pence > 0)) AS covered_to, min(date) AS first_day FROM movement GROUP BY account_id""")
def A10_history_coverage(spark, sf_dir):
    return movements(spark, sf_dir).groupBy("account_id").agg(F.greatest(F.max("date"), F.max(F.when(F.col("amount_pence") > 0, F.last_day("date")))).alias("covered_to"), F.min("date").alias("first_day"))


@query(with_sql(LEDGER) + """, g AS (SELECT merchant_id, account_id, category_id, count(*) AS n, min((date, id)) AS first FROM ledger WHERE amount_pence < 0 AND category_id IS NOT NULL GROUP BY ALL)
    SELECT merchant_id, account_id, CAST(sum(n) AS BIGINT) AS payments, arg_min(category_id, (-n, first)) AS main_category FROM g GROUP BY 1, 2""")
def A11_payment_groups(spark, sf_dir):
    counted = ledger(spark, sf_dir).where("amount_pence < 0 AND category_id IS NOT NULL").groupBy("merchant_id", "account_id", "category_id").agg(F.count("*").alias("n"), F.min(F.struct("date", "id")).alias("first"))
    return counted.groupBy("merchant_id", "account_id").agg(F.sum("n").alias("payments"), F.min_by("category_id", F.struct(-F.col("n"), "first")).alias("main_category"))


@query(with_sql(LEDGER) + "SELECT status, CAST(sum(abs(amount_pence)) AS BIGINT) AS annual_pence, CAST(round_even(sum(abs(amount_pence)) / 12, 0) AS BIGINT) AS monthly_pence, count(*) AS n FROM ledger GROUP BY GROUPING SETS ((status), ())")
def A12_commitment_totals(spark, sf_dir):
    rows = ledger(spark, sf_dir).rollup("status").agg(F.sum(F.abs("amount_pence")).alias("annual_pence"), F.count("*").alias("n"))
    return rows.select("status", "annual_pence", F.bround(F.col("annual_pence") / 12).cast("bigint").alias("monthly_pence"), "n")


@query("""WITH u AS (SELECT role AS task, 'm' || (conv_id % 3) AS model, CAST(conv_id % 28 AS INTEGER) + 1 AS day, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, turn % 5 <> 0 AS ok FROM conversations)
    SELECT task, model, day, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM u GROUP BY GROUPING SETS ((task), (model), (day), ())""")
def A13_usage_summary(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").select(F.col("role").alias("task"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), ((F.col("conv_id") % 28).cast("int") + 1).alias("day"), tokens_estimate(F.col("text")).alias("tokens"), (F.col("turn") % 5 != 0).alias("ok"))
    t, m, d = F.col("task"), F.col("model"), F.col("day")
    return u.groupingSets([[t], [m], [d], []], t, m, d).agg(F.sum("tokens").alias("tokens"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


@query("SELECT CAST(round(sum(CAST(ceil(length(text) / 4) AS BIGINT)) * 5 / 1000000.0, 6) AS DOUBLE) AS cost FROM conversations WHERE turn % 5 <> 0")
def A14_month_spend(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("turn % 5 <> 0").agg(F.round(F.sum(tokens_estimate(F.col("text"))) * 5 / F.lit(1000000.0), 6).cast("double").alias("cost"))


_WAITING = "CASE WHEN status = 'unknown' AND amount_pence > 0 THEN 'income' WHEN status = 'unknown' THEN 'merchant' WHEN status = 'low_confidence' THEN 'review' END"


@query(with_sql(LEDGER) + f"SELECT {_WAITING} AS waiting, count(*) AS n FROM ledger GROUP BY 1 HAVING waiting IS NOT NULL")
def A15_waiting_counts(spark, sf_dir):
    return ledger(spark, sf_dir).select(F.expr(_WAITING).alias("waiting")).where("waiting IS NOT NULL").groupBy("waiting").agg(F.count("*").alias("n"))


@query("SELECT CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)), 0) AS BIGINT) AS pence FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AND event_type = 'purchase'")
def A16_debt_total(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("details", F.try_parse_json("props"))
    return rows.where(F.try_variant_get("details", "$.k", "int") >= 50).agg(F.coalesce(F.sum(F.round(F.col("value") * 100).cast("bigint")), F.lit(0)).alias("pence"))


@query(with_sql(LEDGER) + "SELECT min(date) AS first_day, max(date) AS last_day, coalesce(max(knowledge_version), 0) AS version FROM ledger")
def A17_spans(spark, sf_dir):
    return ledger(spark, sf_dir).agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.coalesce(F.max("knowledge_version"), F.lit(0)).alias("version"))


@query(with_sql(MOVEMENT, BALANCED) + """, s AS (SELECT account_id, CAST(sum(amount_pence) AS BIGINT) AS total, arg_max(balance_after_pence, pos) FILTER (balance_after_pence IS NOT NULL) AS closing, max(pos) AS last_pos, max(pos) FILTER (balance_after_pence IS NOT NULL) AS printed FROM balanced GROUP BY account_id)
    SELECT account_id, 100000 + total AS expected_pence, closing AS closing_pence, abs(100000 + total - closing) <= 1 AS closes FROM s WHERE last_pos = printed""")
def A18_balance_closure(spark, sf_dir):
    s = balances(movements(spark, sf_dir)).groupBy("account_id").agg(F.sum("amount_pence").alias("total"), F.max_by("balance_after_pence", "pos").alias("closing_pence"))
    return s.where("closing_pence IS NOT NULL").select("account_id", (F.col("total") + 100_000).alias("expected_pence"), "closing_pence", (F.abs(F.col("total") + 100_000 - F.col("closing_pence")) <= 1).alias("closes"))


_PREDICTED = "CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END"


@query(f"""SELECT count(*) AS n, CAST(round(avg(CASE WHEN quality = p THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS accuracy, CAST(round(avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS unknown_share
    FROM (SELECT *, {_PREDICTED} AS p FROM labels JOIN documents USING (doc_id))""")
def A19_accuracy(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_PREDICTED).alias("p")), "doc_id")
    return joined.agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("p")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.col("lang").isNull().cast("double")), 6).alias("unknown_share"))


_CHECK = "CASE WHEN amount_pence = 0 THEN 'zero amount' WHEN abs(amount_pence) > 90000 THEN 'large amount' WHEN text LIKE '%REFUND%' THEN 'refund' ELSE 'other' END"


@query(with_sql(MOVEMENT) + f"SELECT {_CHECK} AS label, count(*) AS n FROM movement GROUP BY 1")
def A21_check_summary(spark, sf_dir):
    return movements(spark, sf_dir).select(F.expr(_CHECK).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(with_sql(LEDGER) + "SELECT arg_max(id, (amount_pence > 0, amount_pence, -id)) AS id, count(*) AS n, who FROM ledger WHERE status = 'confirmed' GROUP BY who")
def A24_main_income(spark, sf_dir):
    rank = F.struct(F.col("amount_pence") > 0, "amount_pence", -F.col("id"))
    return ledger(spark, sf_dir).where("status = 'confirmed'").groupBy("who").agg(F.max_by("id", rank).alias("id"), F.count("*").alias("n"))


@query(with_sql(MOVEMENT) + """, c AS (SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(-sum(amount_pence) AS BIGINT) AS spent FROM movement WHERE account_kind = 'credit_card' AND amount_pence < 0 GROUP BY 1, 2)
    SELECT account_id, CAST(month + INTERVAL 1 MONTH + INTERVAL 24 DAY AS DATE) AS date, leg, CASE leg WHEN 'out' THEN -spent ELSE spent END AS amount_pence FROM c, (SELECT unnest(['out', 'in']) AS leg)""")
def A26_card_repayments(spark, sf_dir):
    spent = movements(spark, sf_dir).where("account_kind = 'credit_card' AND amount_pence < 0").groupBy("account_id", F.trunc("date", "month").alias("month")).agg((-F.sum("amount_pence")).alias("spent"))
    legs = spent.withColumn("leg", F.explode(F.array(F.lit("out"), F.lit("in"))))
    return legs.select("account_id", F.date_add(F.add_months("month", 1), 24).alias("date"), "leg", F.when(F.col("leg") == "out", -F.col("spent")).otherwise(F.col("spent")).alias("amount_pence"))


@query(with_sql(LEDGER) + "SELECT id, date, amount_pence, category_id FROM ledger WHERE NOT ignored AND category_id LIKE 'asia.%' ORDER BY date DESC, id LIMIT 200 OFFSET 400")
def T1_transactions_page(spark, sf_dir):
    return spending.page(ledger(spark, sf_dir).where(~F.col("ignored") & spending.in_subtree("category_id", "asia")), 200, 400).select("id", "date", "amount_pence", "category_id")


@query(with_sql(LEDGER) + "SELECT id, abs(amount_pence) AS pence FROM ledger WHERE status IN ('unknown', 'low_confidence') ORDER BY CASE status WHEN 'unknown' THEN 0 ELSE 1 END, abs(amount_pence) DESC, date DESC, id LIMIT 200")
def T2_backlog(spark, sf_dir):
    rows = ledger(spark, sf_dir).where(F.col("status").isin("unknown", "low_confidence"))
    return rows.orderBy(F.when(F.col("status") == "unknown", 0).otherwise(1), F.desc(F.abs("amount_pence")), F.desc("date"), "id").limit(200).select("id", F.abs("amount_pence").alias("pence"))


@query(with_sql(LEDGER) + "SELECT id, date FROM ledger WHERE status = 'unknown' ORDER BY abs(amount_pence) DESC, date DESC, id LIMIT 50")
def T3_queue(spark, sf_dir):
    return ledger(spark, sf_dir).where("status = 'unknown'").orderBy(F.desc(F.abs("amount_pence")), F.desc("date"), "id").limit(50).select("id", "date")


@query("SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 100")
def T4_keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id < 5000").orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type")


@query(with_sql(LEDGER, CATEGORY, _TOTALS) + "SELECT split_part(category_id, '.', 1) AS tile, CAST(-sum(net_pence) AS BIGINT) AS amount_pence FROM totals JOIN category ON category_id = id WHERE kind = 'spend' GROUP BY 1 HAVING -sum(net_pence) > 0 ORDER BY 2 DESC, 1 LIMIT 3")
def T5_top_tiles(spark, sf_dir):
    tiles = spending.breakdown(period_rows(spark, sf_dir), categories(spark, sf_dir)).where("tile <> 'unsorted'")
    return tiles.orderBy(F.desc("amount_pence"), "tile").limit(3).select("tile", "amount_pence")


@query(with_sql(LEDGER) + "SELECT id, merchant_id, rank FROM (SELECT id, merchant_id, row_number() OVER (PARTITION BY merchant_id ORDER BY abs(amount_pence) DESC, id) AS rank FROM ledger) WHERE rank <= 20")
def T6_biggest_rows(spark, sf_dir):
    return temporal.newest(ledger(spark, sf_dir), ["merchant_id"], [F.desc(F.abs("amount_pence")), "id"], 20).select("id", "merchant_id", F.col("rank").cast("bigint").alias("rank"))


@query(with_sql(LEDGER) + "SELECT status, merchant_id, CAST(sum(abs(amount_pence)) AS BIGINT) AS pence FROM ledger GROUP BY 1, 2 ORDER BY status, pence DESC, merchant_id")
def T7_commitment_order(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("status", "merchant_id").agg(F.sum(F.abs("amount_pence")).alias("pence")).orderBy("status", F.desc("pence"), "merchant_id")


@query("SELECT user_id, array_to_string(list_slice(list(k ORDER BY last), -5, -1), ',') AS recent FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, max(event_id) AS last FROM events GROUP BY 1, 2) GROUP BY user_id")
def T9_recent_list(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.max("event_id").alias("last"))
    return temporal.newest(seen, ["user_id"], [F.desc("last")], 5).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "k"))), lambda x: x["k"].cast("string")), ",").alias("recent"))


@query(with_sql(MOVEMENT, BALANCED) + """, a AS (SELECT *, last_value(CASE WHEN balance_after_pence IS NOT NULL THEN {'p': balance_after_pence, 't': s} END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
    FROM (SELECT *, CAST(sum(amount_pence) OVER (PARTITION BY account_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM balanced))
    SELECT account_id, id, pos, balance_after_pence, b.p + s - b.t AS expected_pence FROM a WHERE abs(balance_after_pence - (b.p + s - b.t)) > 1""")
def WN12_running_balance(spark, sf_dir):
    return temporal.running_mismatches(balances(movements(spark, sf_dir)), ["account_id"]).withColumn("pos", F.col("pos").cast("bigint"))


@query(with_sql(MOVEMENT, BALANCED) + """, s AS (SELECT *, CAST(sum(amount_pence) OVER (PARTITION BY account_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM balanced)
    SELECT account_id, arg_min(balance_after_pence - s, pos) FILTER (balance_after_pence IS NOT NULL) AS opening_pence, CAST(arg_max(balance_after_pence - s, pos) FILTER (balance_after_pence IS NOT NULL) + sum(amount_pence) AS BIGINT) AS closing_pence, count(*) AS n FROM s GROUP BY account_id""")
def WN13_implied_balances(spark, sf_dir):
    return temporal.implied_balances(balances(movements(spark, sf_dir)), ["account_id"])


@query(with_sql(MOVEMENT, BALANCED) + "SELECT account_id, date, balance_after_pence FROM (SELECT *, row_number() OVER (PARTITION BY account_id, date ORDER BY id DESC) AS n FROM balanced WHERE balance_after_pence IS NOT NULL) WHERE n = 1")
def WN15_latest_balance(spark, sf_dir):
    printed = balances(movements(spark, sf_dir)).where("balance_after_pence IS NOT NULL")
    return temporal.latest_per_day(printed, ["account_id"], "date", "id").select("account_id", "date", "balance_after_pence")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 20")
def WN16_history(spark, sf_dir):
    return temporal.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 20).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


_EDITS = "e AS (SELECT user_id AS subject, event_type AS attribute, CAST(ts AS DATE) AS valid_from, CAST(round(value * 100) AS BIGINT) AS val, event_id FROM events)"


@query(f"WITH {_EDITS} SELECT subject, attribute, valid_from, val, lead(valid_from) OVER (PARTITION BY subject, attribute ORDER BY valid_from) AS valid_to FROM (SELECT *, row_number() OVER (PARTITION BY subject, attribute, valid_from ORDER BY event_id DESC) AS n FROM e) WHERE n = 1")
def WN17_timeline(spark, sf_dir):
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("attribute"), F.col("ts").cast("date").alias("valid_from"), F.round(F.col("value") * 100).cast("bigint").alias("val"), "event_id")
    return temporal.intervals(edits, ["subject", "attribute"], "valid_from", "event_id").drop("event_id")


@query(with_sql(MOVEMENT) + "SELECT id, account_id, date_diff('day', lag(date) OVER (PARTITION BY account_id ORDER BY date, id), date) AS gap_days FROM movement")
def WN1_gaps(spark, sf_dir):
    return temporal.gaps(movements(spark, sf_dir), ["account_id"]).select("id", "account_id", F.col("gap_days").cast("bigint").alias("gap_days"))


@query("""WITH p AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS val FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, e.user_id, p.val, p.event_id AS from_event FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def J11_as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("from_event"), F.col("ts").alias("since"), F.round(F.col("value") * 100).cast("bigint").alias("val"))
    return temporal.as_of(left, right, ["user_id"], "ts", "since", ["val", "from_event"]).select("event_id", "user_id", "val", "from_event")


@query(with_sql(MOVEMENT) + ", n AS (SELECT DISTINCT account_id, CAST(day(date) AS INTEGER) AS n FROM movement) SELECT account_id, min(n) AS first, max(n) AS last FROM (SELECT *, n - row_number() OVER (PARTITION BY account_id ORDER BY n) AS island FROM n) GROUP BY account_id, island")
def U3_islands(spark, sf_dir):
    days = movements(spark, sf_dir).select("account_id", F.day("date").alias("n")).distinct()
    return temporal.islands(days, ["account_id"], "n")
