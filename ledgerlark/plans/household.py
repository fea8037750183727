"""Joins and small operators of accounts, statements, commitments and settings over the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.money import priced
from ..functions.text import header_key, iban_valid, tokens_estimate
from ..operators import spending, understanding
from ..sources import files
from .adapter import CATEGORY, LEDGER, MOVEMENT, categories, ledger, movements, table, with_sql
from .registry import query


@query("SELECT o_orderkey AS id, c_mktsegment AS kind, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def J1_transaction_understanding(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("o_orderstatus").alias("status"))


@query(with_sql(LEDGER, CATEGORY) + "SELECT l.id, c.label, c.kind, s.s_name AS merchant FROM ledger l LEFT JOIN category c ON l.category_id = c.id LEFT JOIN supplier s ON l.merchant_id = s.s_suppkey AND s.s_acctbal > 0")
def J2_dimensions(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant"))
    rows = ledger(spark, sf_dir).select("id", "category_id", "merchant_id")
    return rows.join(categories(spark, sf_dir).select(F.col("id").alias("category_id"), "label", "kind"), "category_id", "left").join(named, "merchant_id", "left").select("id", "label", "kind", "merchant")


@query("SELECT c_custkey, coalesce(list_aggregate(list_sort(o.owners), 'string_agg', ','), '') AS owners FROM customer LEFT JOIN (SELECT user_id, list(DISTINCT event_type) AS owners FROM events GROUP BY 1) o ON o.user_id = c_custkey")
def J3_account_owners(spark, sf_dir):
    owners = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_sort(F.collect_set("event_type")).alias("owners"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(owners, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("owners", ","), F.lit("")).alias("owners"))


@query(with_sql(MOVEMENT) + ", p AS (SELECT id, text, id - id % 7 + (id % 7 + 1) % 7 AS pair_id FROM movement) SELECT DISTINCT id FROM (SELECT id FROM p WHERE text LIKE 'REFUND%' UNION ALL SELECT b.id FROM p a JOIN p b ON b.pair_id = a.id WHERE a.text LIKE 'REFUND%')")
def J10_released_partners(spark, sf_dir):
    p = movements(spark, sf_dir).select("id", "text", (F.col("id") - F.col("id") % 7 + (F.col("id") % 7 + 1) % 7).alias("pair_id"))
    own = p.where("text LIKE 'REFUND%'").select("id")
    return own.unionByName(p.join(own.select(F.col("id").alias("pair_id")), "pair_id").select("id")).distinct()


@query("SELECT DISTINCT l_suppkey AS statement_id, l_orderkey AS transaction_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def J12_statement_links(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().join(stored, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("statement_id"), F.col("l_orderkey").alias("transaction_id"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events)")
def J14_id_set(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT event_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE))")
def J16_not_running(spark, sf_dir):
    day = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return day.where("event_type = 'click'").join(day.where("event_type = 'error'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("event_id")


@query("SELECT l_orderkey AS commitment_id, l_linenumber AS payment, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def J17_commitment_payments(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(dated, "l_orderkey").select(F.col("l_orderkey").alias("commitment_id"), F.col("l_linenumber").alias("payment"), "date").orderBy("date", "commitment_id")


@query("SELECT s_suppkey, s_nationkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_custkey % 50 = s.s_suppkey % 50)")
def J18_income_not_owner(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 50).alias("person"))
    return table(spark, sf_dir, "supplier").withColumn("person", F.col("s_suppkey") % 50).join(owners, ["s_nationkey", "person"], "left_anti").select("s_suppkey", "s_nationkey")


@query(with_sql(LEDGER) + "SELECT id FROM ledger WHERE NOT ignored AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND who = 'household' AND status = 'confirmed'")
def P7_spending_filter(spark, sf_dir):
    return ledger(spark, sf_dir).where(spending.spending_filter("1997-01-01", "1998-12-31", who="household", status="confirmed")).select("id")


@query("SELECT p_partkey, substr(sha256(lower(p_name) || '|' || lower(p_brand) || '|amount (gbp)'), 1, 16) AS key FROM part")
def F8_header_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", header_key(F.array("p_name", F.concat(F.lit(" "), F.upper("p_brand")), F.lit("Amount  (GBP)"))).alias("key"))


@query("""WITH b AS (SELECT c_custkey, 'ACME' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS bban FROM customer), r AS (SELECT *, CAST('10122214' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '161100' AS HUGEINT) % 97 AS rest FROM b)
    SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM r""")
def F23_iban_check(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("n"))
    rest = (F.concat(F.lit("10122214"), F.col("n"), F.lit("161100")).cast("decimal(38,0)") % 97).cast("int")
    digits = 98 - rest + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(F.when(98 - rest > 50, -1).otherwise(1))
    return own.select("c_custkey", iban_valid(F.concat(F.lit("GB"), F.lpad(digits.cast("string"), 2, "0"), F.lit("ACME"), F.col("n"))).alias("valid"))


@query(with_sql(MOVEMENT) + "SELECT account_id, CAST(date_trunc('month', date) AS DATE) AS period_start, last_day(date) AS period_end, CAST(sum(amount_pence) AS BIGINT) AS net_pence FROM movement GROUP BY 1, 2, 3")
def F18_months(spark, sf_dir):
    return movements(spark, sf_dir).groupBy("account_id", F.trunc("date", "month").alias("period_start"), F.last_day("date").alias("period_end")).agg(F.sum("amount_pence").alias("net_pence"))


@query(with_sql(CATEGORY) + "SELECT id, EXISTS (SELECT 1 FROM category d WHERE d.parent_id = c.id) AS has_children, (id = 'asia' OR id LIKE 'asia.%') AS retired FROM category c")
def D16_retired_subtree(spark, sf_dir):
    c = categories(spark, sf_dir)
    parents = c.select(F.col("parent_id").alias("id")).distinct().withColumn("has", F.lit(True))
    return c.join(parents, "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has_children"), spending.in_subtree("id", "asia").alias("retired"))


@query(with_sql(LEDGER) + "SELECT id, 'moved' AS category_id FROM ledger WHERE decided_by = 'rule' AND status <> 'confirmed' AND category_id LIKE 'asia.%'")
def D15_refile_undo(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    moves = rows.where("decided_by = 'rule'").select("id", F.lit("asia").alias("moved_to"))
    same = moves.join(rows.where("status <> 'confirmed'"), "id").where(spending.in_subtree("category_id", "asia"))
    return same.select("id", F.lit("moved").alias("category_id"))


_GROUPS = "gr AS (SELECT category_id, merchant_id, 'g' || (merchant_id % 3) AS g FROM (SELECT DISTINCT category_id, merchant_id FROM ledger WHERE category_id LIKE 'asia.%'))"


@query(with_sql(LEDGER, _GROUPS) + ", ok AS (SELECT category_id FROM gr GROUP BY 1 HAVING count(DISTINCT g) >= 2) SELECT id, category_id, category_id || '.' || g AS moved_to FROM ledger JOIN gr USING (category_id, merchant_id) WHERE status <> 'confirmed' AND category_id IN (SELECT category_id FROM ok)")
def D4_refile(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    groups = rows.where("category_id LIKE 'asia.%'").select("category_id", "merchant_id").distinct().withColumn("group", F.concat(F.lit("g"), (F.col("merchant_id") % 3).cast("string")))
    return understanding.refiled(rows, groups)


@query("SELECT event_type AS kind, arg_min(event_id, (ts, event_id)) AS id FROM events e WHERE event_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 100 = 1 AND r.event_type = e.event_type AND r.user_id = e.user_id) GROUP BY 1")
def T8_next_jobs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 100 == 1, "running").when(F.col("event_id") % 3 == 0, "queued").otherwise("done")
    both = events.withColumn("state", state).unionByName(events.where("event_id % 3 = 0 AND event_id % 100 = 1").withColumn("state", F.lit("queued")))
    jobs = both.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("scope"), "state", F.col("ts").alias("run_after"))
    return understanding.claimed(jobs, datetime.datetime(2024, 1, 20)).select("kind", "id")


@query("SELECT page_id, CASE WHEN regexp_matches(html, '^\\s*<') THEN NULL ELSE 'csv' END AS kind, sha256(html) AS sha256 FROM pages")
def S1_file_kinds(spark, sf_dir):
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", files.kind_of(content)["kind"].alias("kind"), F.sha2(content, 256).alias("sha256"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def S2_decoded_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16"))
    return docs.select("doc_id", files.decoded(content).alias("text"))


@query("SELECT conv_id, CAST(round(sum(ceil(length(text) / 4) * CASE WHEN role = 'user' THEN 5 ELSE 15 END) / 1000000.0 * 0.8, 9) AS DOUBLE) AS cost FROM conversations GROUP BY conv_id")
def F28_priced_cost(spark, sf_dir):
    tokens = tokens_estimate(F.col("text"))
    own = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", tokens).otherwise(0).alias("i"), F.when(F.col("role") == "user", 0).otherwise(tokens).alias("o"))
    summed = own.groupBy("conv_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return summed.select("conv_id", F.round(priced(F.col("i"), F.col("o"), F.lit(None).cast("double"), F.lit(None).cast("double"), 0.8), 9).alias("cost"))
