"""Operators over lines, on documents and events written as statement lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import pounds
from ..operators import documents as X
from .adapter import MOVEMENT, movements, table, with_sql
from .registry import query

_SHOWN = "CASE WHEN amount_pence < 0 THEN '-' ELSE '' END || (abs(amount_pence) // 100) || '.' || lpad(CAST(abs(amount_pence) % 100 AS VARCHAR), 2, '0')"
_LINES = f"l AS (SELECT account_id, id, amount_pence, row_number() OVER (PARTITION BY account_id ORDER BY date, id) AS pos, CASE WHEN id % 6 = 0 THEN 'Closing balance ' ELSE '' END || CASE WHEN id % 5 = 0 THEN text ELSE strftime(date, '%d/%m/%Y') || ' ' || text || ' ' || ({_SHOWN}) END AS text FROM movement)"


def _lines(spark, sf_dir):
    rows = movements(spark, sf_dir)
    shown = F.when(F.col("id") % 5 == 0, F.col("text")).otherwise(F.concat_ws(" ", F.date_format("date", "dd/MM/yyyy"), "text", pounds(F.col("amount_pence"))))
    pos = F.row_number().over(Window.partitionBy("account_id").orderBy("date", "id"))
    return rows.select("account_id", "id", "amount_pence", pos.alias("pos"), F.concat(F.when(F.col("id") % 6 == 0, "Closing balance ").otherwise(""), shown).alias("text"))


@query(with_sql(MOVEMENT, _LINES) + ", r AS (SELECT account_id, pos, lead(pos) OVER (PARTITION BY account_id ORDER BY pos) AS next FROM l WHERE id % 5 <> 0 AND id % 6 <> 0) SELECT account_id, coalesce(min(pos) FILTER (next - pos <= 2), min(pos)) AS start FROM r GROUP BY 1")
def S17_table_start(spark, sf_dir):
    return X.table_starts(_lines(spark, sf_dir), "account_id", F.lit(False)).select("account_id", F.col("start").cast("bigint").alias("start"))


@query(with_sql(MOVEMENT, _LINES) + ", m AS (SELECT *, sum(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY pos) AS run FROM l) SELECT account_id, min(pos) AS first, max(pos) AS last FROM m WHERE id % 3 <> 0 GROUP BY account_id, run HAVING bool_or(text LIKE '%REFUND%') OR (count(*) >= 3 AND bool_and(id % 5 = 0))")
def B1_blocks(spark, sf_dir):
    found = X.blocks(_lines(spark, sf_dir), "account_id", F.col("id") % 3 != 0, F.contains("text", F.lit("REFUND")), F.col("id") % 5 == 0)
    return found.select("account_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query(with_sql(MOVEMENT, _LINES) + "SELECT id, id % 5 <> 0 AS printed, id % 5 <> 0 AND amount_pence < 0 AND id % 4 = 0 AS wrong FROM l")
def D13_row_evidence(spark, sf_dir):
    own = _lines(spark, sf_dir)
    read = F.when(F.col("id") % 4 == 0, F.abs("amount_pence")).otherwise(F.col("amount_pence"))
    return own.select("id", X.evidence(F.col("text"), F.col("amount_pence")).alias("printed"), X.household_sign_wrong(F.col("text"), read).alias("wrong"))


@query("""SELECT s_suppkey, lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS last4, s_suppkey * 7 AS opening_pence, -(s_suppkey * 3 + 1) AS closing_pence, s_suppkey % 2 = 0 AS card, s_suppkey % 2 = 1 AS debit, DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS period_start, DATE '2024-01-29' + CAST(s_suppkey % 300 AS INTEGER) AS period_end FROM supplier""")
def P19_header_facts(spark, sf_dir):
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    period = F.when(k % 3 == 0, F.concat(F.lit("Period: "), F.date_format(start, "dd/MM/yyyy"), F.lit(" to "), F.date_format(F.date_add(start, 28), "dd/MM/yyyy"))).otherwise(F.concat(F.lit("from "), F.date_format(start, "d MMMM yyyy"), F.lit(" until "), F.date_format(F.date_add(start, 28), "d MMMM yyyy")))
    text = F.concat(F.when(k % 2 == 0, "Credit limit\n").otherwise("Current account\n"), F.lit("Account number: **** **** "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n"), period, F.lit("\nOpening balance: £"), pounds(k * 7), F.lit("\nClosing balance: -£"), pounds(k * 3 + 1))
    facts = X.header_facts(text)
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[facts[c].alias(c) for c in ("last4", "opening_pence", "closing_pence", "card", "debit", "period_start", "period_end")])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 AND p_partkey % 40 BETWEEN 1 AND 31 THEN 0 ELSE 1 END AS codes FROM part")
def B8_sort_codes(spark, sf_dir):
    k = F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(k % 3 == 0, F.concat(F.lit("to 20-"), two(k % 90), F.lit("-11 x"))).when(k % 3 == 1, F.concat(F.lit("on "), two(k % 40), F.lit(" 11 24 x"))).otherwise(F.concat(two(k % 40), F.lit(".11/24")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(X.sort_codes(text)).alias("codes"))


@query("SELECT p_partkey, p_name || ' 12' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || '05' AS text FROM part")
def B9_look_alikes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.look_alikes(F.concat(F.col("p_name"), F.lit(" l2"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("OS"))).alias("text"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[a-z]+\\.[0-9]+@[a-z0-9.]+'))) AS stand_ins FROM documents WHERE regexp_matches(text, '[a-z]+\\.[0-9]+@[a-z0-9.]+')")
def B11_stand_ins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), "text")
    shown, mapping = X.stand_ins(docs, "doc_id", r"[a-z]+\.[0-9]+@[a-z0-9.]+", "MAIL")
    counted = mapping.groupBy("doc_id").agg(F.count("*").alias("stand_ins"))
    return shown.where(F.contains("text", F.lit("MAIL_1"))).join(counted, "doc_id").select("doc_id", "stand_ins")


@query("SELECT event_id, CAST(ts AS DATE) AS date, CASE WHEN event_id % 4 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS amount_pence, CASE WHEN event_id % 4 = 0 THEN 'no amount' WHEN round(value * 100) = 0 THEN 'zero amount' END AS reason FROM events")
def P22_reader_replies(spark, sf_dir):
    p = F.round(F.col("value") * 100).cast("bigint")
    reply = F.concat(F.lit('Sure: [{"ref": "L1", "date": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('", "amount": "'), F.when(F.col("event_id") % 4 == 0, "?").otherwise(pounds(p)), F.lit('", "description": "x"}]'))
    replies = table(spark, sf_dir, "events").select("event_id", reply.alias("text"))
    return X.reply_rows(replies, "event_id").select("event_id", "date", "amount_pence", "reason")


@query("SELECT c_custkey, 'Pay ' || c_name || ' to ' || c_mktsegment AS text FROM customer")
def F38_restored(spark, sf_dir):
    hidden = F.create_map(F.lit("[name_1]"), F.col("c_name"), F.lit("[segment]"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.restored(F.lit("Pay [name_1] to [segment]"), hidden).alias("text"))


@query()
def F20_normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalised(F.col("text")).alias("text"))


@query("SELECT page_id, count(*) AS rows FROM (SELECT page_id, unnest(range(0, 4 + CAST(page_id % 3 AS INTEGER))) AS r FROM pages) GROUP BY 1")
def S15_rows_from_boxes(spark, sf_dir):
    cells = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3 + 3).cast("int"))).alias("r"))
    boxes = cells.select("page_id", "r", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
    placed = boxes.select("page_id", (F.col("c") * 100.0).alias("left"), (F.col("c") * 100.0 + 40).alias("right"), (F.col("r") * 20.0 + F.col("c") * 2).alias("top"), (F.col("r") * 20.0 + 12).alias("bottom"), F.lit("word").alias("text"))
    return X.rows_from_boxes(placed, "page_id").where("text = 'word   word'").groupBy("page_id").agg(F.count("*").alias("rows"))
