"""Recurring payments, calendars and periods over the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.money import pounds, printed_pence
from ..functions.text import first_json, masked, sensitive_classes, slug, tokens_estimate
from ..operators import series
from ..operators.temporal import as_of
from .adapter import LEDGER, MOVEMENT, ledger, movements, table, with_sql
from .registry import query


@query()
def WN10_detected_series(spark, sf_dir):
    paid = ledger(spark, sf_dir).where("amount_pence < 0").select("merchant_id", "account_id", "id", "date", (-F.col("amount_pence")).alias("pence"))
    return series.detect(paid, datetime.date(2001, 8, 1), 0.5).select("merchant_id", "account_id", "cadence", "expected_pence", "next_due", "occurrences", "status", "annual_pence")


_GAPS = "g AS (SELECT account_id, date, date_diff('day', lag(date) OVER (PARTITION BY account_id ORDER BY date), date) AS gap FROM (SELECT DISTINCT account_id * 10 + isodow(date) AS account_id, date FROM movement))"
_FITS = " UNION ALL ".join(
    f"SELECT account_id, '{c}' AS cadence, avg(CASE WHEN round_even(gap / {n}, 0) = 1 THEN 1.0 ELSE 0.0 END) AS share, {n} AS nominal FROM g WHERE gap IS NOT NULL GROUP BY account_id HAVING bool_and(round_even(gap / {n}, 0) BETWEEN 1 AND 3 AND abs(gap - round_even(gap / {n}, 0) * {n}) <= {t} * round_even(gap / {n}, 0)) AND share >= 0.6"
    for c, (n, t, *_) in D.CADENCES.items() if c not in ("monthly",)
)


@query(with_sql(MOVEMENT, _GAPS, f"f AS ({_FITS})") + "SELECT account_id, cadence, CAST(round(share, 6) AS DOUBLE) AS share FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY share DESC, nominal) AS k FROM f) WHERE k = 1")
def WN3_cadence_fit(spark, sf_dir):
    rows = movements(spark, sf_dir).select((F.col("account_id") * 10 + F.weekday("date") + 1).alias("account_id"), "date").distinct()
    return series.fitted_cadence(rows, ["account_id"]).select("account_id", "cadence", "share")


_STEP = "CASE WHEN c_custkey % 4 = 0 THEN d + 14 ELSE CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) + CAST(least(CASE WHEN c_custkey % 4 = 1 THEN 31 ELSE day(d) END, day(last_day(CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)))) - 1 AS INTEGER) END"


@query(f"WITH x AS (SELECT c_custkey, DATE '2023-01-01' + CAST(c_custkey % 500 AS INTEGER) AS d FROM customer) SELECT c_custkey, CAST({_STEP} AS DATE) AS next_due FROM x")
def WN11_next_due(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(F.lit(datetime.date(2023, 1, 1)), (F.col("c_custkey") % 500).cast("int")).alias("d"))
    cadence = F.when(F.col("c_custkey") % 4 == 0, "fortnightly").otherwise("monthly")
    wanted = F.when(F.col("c_custkey") % 4 == 1, 0).otherwise(F.day("d"))
    return x.select("c_custkey", D.next_due(F.col("d"), cadence, wanted, F.array().cast("array<int>")).alias("next_due"))


@query("""SELECT c_custkey, CAST(date_trunc('month', d) + INTERVAL (m) MONTH AS DATE) + CAST(least(day(d), day(last_day(CAST(date_trunc('month', d) + INTERVAL (m) MONTH AS DATE)))) - 1 AS INTEGER) AS moved
    FROM (SELECT c_custkey, DATE '2023-01-01' + CAST(c_custkey % 700 AS INTEGER) AS d, CAST(c_custkey % 25 AS INTEGER) - 12 AS m FROM customer)""")
def F14_add_months(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(F.lit(datetime.date(2023, 1, 1)), (F.col("c_custkey") % 700).cast("int")).alias("d"), ((F.col("c_custkey") % 25).cast("int") - 12).alias("m"))
    return x.select("c_custkey", D.month_add(F.col("d"), F.col("m"), F.lit(None).cast("int")).alias("moved"))


#: Days off by division, the same in every year that orders fall in.
DAYS_OFF = {"england": ("01-01", "04-10", "04-13", "05-04", "05-25", "08-31", "12-25", "12-28"), "scotland": ("01-01", "01-02", "04-10", "05-04", "08-03", "11-30", "12-25", "12-28")}
HOLIDAYS = [(division, f"{year}-{day}") for division, days in DAYS_OFF.items() for year in range(1994, 2003) for day in days]
_HOLIDAY = "holiday(division, day) AS (VALUES " + ", ".join(f"('{a}', DATE '{b}')" for a, b in HOLIDAYS) + ")"


def holidays(spark):
    return spark.createDataFrame([(a, datetime.date.fromisoformat(b)) for a, b in HOLIDAYS], "division string, day date")


@query(with_sql(_HOLIDAY, "days AS (SELECT division, CAST(d AS DATE) AS day FROM generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY) g(d), (SELECT DISTINCT division FROM holiday))", "working AS (SELECT * FROM days WHERE isodow(day) < 6 AND (division, day) NOT IN (SELECT division, day FROM holiday))") + """
    SELECT o_orderkey, w.division, max(w.day) AS pay_day FROM orders JOIN working w ON w.day <= CAST(o_orderdate AS DATE) AND w.day > CAST(o_orderdate AS DATE) - 10 AND w.division = CASE WHEN o_orderkey % 2 = 0 THEN 'england' ELSE 'scotland' END GROUP BY 1, 2""")
def F16_working_day(spark, sf_dir):
    calendar = D.working_days(spark, "1994-12-01", "2002-12-31", holidays(spark))
    keyed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "england").otherwise("scotland").alias("division"))
    return keyed.join(calendar, ["day", "division"]).select("o_orderkey", "division", F.col("previous").alias("pay_day"))


@query("""WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 31 AS INTEGER) + 1 AS wanted FROM supplier), m AS (SELECT CAST(d AS DATE) AS month FROM generate_series(DATE '2024-01-01', DATE '2024-12-01', INTERVAL 1 MONTH) g(d))
    SELECT s_suppkey, month + CAST(least(wanted, day(last_day(month))) - 1 AS INTEGER) AS pay_day FROM s, m""")
def F17_pay_dates(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 31).cast("int") + 1).alias("wanted"))
    months = own.withColumn("month", F.explode(F.sequence(F.lit(datetime.date(2024, 1, 1)), F.lit(datetime.date(2024, 12, 1)), F.expr("interval 1 month"))))
    return months.select("s_suppkey", D.month_add(F.col("month"), F.lit(0), F.col("wanted")).alias("pay_day"))


@query(with_sql(MOVEMENT) + """, pay AS (SELECT account_id, date AS start, lead(date) OVER (PARTITION BY account_id ORDER BY date) - 1 AS stop FROM (SELECT DISTINCT account_id, date FROM movement WHERE amount_pence > 20000))
    SELECT m.id, p.start AS period_start, p.stop AS period_end FROM movement m ASOF LEFT JOIN pay p ON m.account_id = p.account_id AND m.date >= p.start""")
def F18_pay_cycle(spark, sf_dir):
    moves = movements(spark, sf_dir)
    pay = moves.where("amount_pence > 20000").select("account_id", F.col("date").alias("start")).distinct()
    ended = pay.withColumn("stop", F.date_sub(F.lead("start").over(Window.partitionBy("account_id").orderBy("start")), 1)).withColumn("period_start", F.col("start"))
    return as_of(moves.select("account_id", "id", "date"), ended, ["account_id"], "date", "start", ["period_start", "stop"]).select("id", "period_start", F.col("stop").alias("period_end"))


@query(with_sql(LEDGER) + ", s AS (SELECT merchant_id, max(date) AS last FROM ledger GROUP BY 1) SELECT merchant_id, CAST(last + CAST(28 * k AS INTEGER) AS DATE) AS due FROM s, (SELECT unnest(range(1, 120)) AS k) WHERE last + CAST(28 * k AS INTEGER) BETWEEN DATE '2001-08-01' AND DATE '2002-08-01'")
def D9_projected_dates(spark, sf_dir):
    last = ledger(spark, sf_dir).groupBy("merchant_id").agg(F.max("date").alias("last"))
    own = last.select("merchant_id", F.lit("four_weekly").alias("cadence"), F.date_add("last", 28).alias("next_due"), F.lit(None).cast("int").alias("expected_day"), F.array().cast("array<int>").alias("skip_months"))
    return series.due_dates(own, datetime.date(2001, 8, 1), datetime.date(2002, 8, 1)).select("merchant_id", "due")


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS BIGINT) AS pence FROM events""")
def F3_printed_money(spark, sf_dir):
    shown = F.format_string("%,.2f", F.round("value", 2))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("(£"), shown, F.lit(")"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("GBP "), shown)).otherwise(F.concat(F.lit("£"), shown, F.lit(" CR")))
    return table(spark, sf_dir, "events").select("event_id", printed_pence(text).alias("pence"))


@query("SELECT event_id, CASE WHEN p < 0 THEN '-' ELSE '' END || (abs(p) // 100) || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS pounds FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT) AS p FROM events)")
def F2_format_pounds(spark, sf_dir):
    p = F.when(F.col("event_type") == "purchase", -1).otherwise(1) * F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", pounds(p).alias("pounds"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders")
def F4_printed_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.upper(F.date_format("o_orderdate", "dd-MMM-yy"))).otherwise(F.concat(F.date_format("o_orderdate", "d"), F.lit("th "), F.date_format("o_orderdate", "MMMM  yyyy")))
    return orders.select("o_orderkey", D.printed_date(shown).alias("date"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def F26_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS mail, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS INTEGER) AS masked FROM documents")
def F22_masking(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_contains(sensitive_classes(text), "email").alias("mail"), F.regexp_count(masked(text), F.lit(r"\[email\]")).alias("masked"))


@query("SELECT p_partkey, lower(replace(replace(p_type || ' & ' || p_name, ' & ', '-and-'), ' ', '-')) || CASE p_partkey % 3 WHEN 0 THEN '-orseg-sile' WHEN 1 THEN '-ha-noi-cafe' ELSE '' END AS slug FROM part")
def F12_slug(spark, sf_dir):
    more = F.when(F.col("p_partkey") % 3 == 0, " Őrség/Şile!").when(F.col("p_partkey") % 3 == 1, " Hà Nội «Cafe\u0301»").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_type", F.lit(" & "), "p_name", more)).alias("slug"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def F24_json_in_prose(spark, sf_dir):
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(first_json(reply), "$.k", "int").alias("k"))


@query("SELECT DISTINCT last_day(CAST(ts AS DATE)) AS month_end, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def F37_month_grid(spark, sf_dir):
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(F.last_day(day).alias("month_end"), F.date_trunc("week", "ts").cast("date").alias("week")).distinct()
