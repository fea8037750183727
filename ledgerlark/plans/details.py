"""Operators of accounts, people, layouts and scalars over the driver tables, each beside its SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import bank_holidays, month_grid, next_due
from ..functions.money import figures, pounds, printed_figures, typed_amount
from ..functions.text import clean, display_name, fingerprint, phrase_in, sensitive_classes, similar_tokens, variant
from ..operators import accounts, composites, documents, matching, privacy, redaction, rules, series, sinks, spending, understanding
from ..shared import dealt_by_rows, shared_dir
from ..sources import delimited
from ..sources.layouts import LAYOUTS
from .adapter import CATEGORY, LEDGER, MOVEMENT, categories, ledger, movements, table, with_sql
from .ingesting import _csv
from .registry import query

# Scalars


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '£1,234.5' WHEN 1 THEN '-' || (c_custkey + 1) || '.05' WHEN 2 THEN '2000000000' WHEN 3 THEN 'abc' WHEN 4 THEN ' ' || c_custkey || ' ' WHEN 5 THEN repeat('1', 40) ELSE '12,34' END AS raw FROM customer)
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 123450 WHEN 4 THEN c_custkey * 100 END AS pence, CASE c_custkey % 7 WHEN 1 THEN 'negative' WHEN 2 THEN 'too large' WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE 'not an amount' END AS problem,
        CASE c_custkey % 7 WHEN 0 THEN 123450 WHEN 1 THEN -((c_custkey + 1) * 100 + 5) WHEN 4 THEN c_custkey * 100 END AS signed_pence FROM t""")
def F1_typed_pounds(spark, sf_dir):
    k = F.col("c_custkey")
    choices = ["£1,234.5", F.concat(F.lit("-"), (k + 1).cast("string"), F.lit(".05")), "2000000000", "abc", F.concat(F.lit(" "), k.cast("string"), F.lit(" ")), "1" * 40, "12,34"]
    raw = F.coalesce(*[F.when(k % 7 == i, c) for i, c in enumerate(choices)])
    own = table(spark, sf_dir, "customer").select("c_custkey", typed_amount(raw).alias("t"), typed_amount(raw, True).alias("s"))
    return own.select("c_custkey", "t.pence", "t.problem", F.col("s.pence").alias("signed_pence"))


@query("""WITH l AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderkey % 4 AS k FROM orders),
    f AS (SELECT *, format('{:,}', p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS shown FROM l)
    SELECT o_orderkey, 5 + CASE k WHEN 3 THEN 0 ELSE 1 END AS start, 5 + CASE k WHEN 3 THEN 0 ELSE 1 END + length(shown) AS "end", p AS pence, k <> 0 AS negative, p AS second FROM f""")
def F5_printed_figures(spark, sf_dir):
    pence, k = F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_orderkey") % 4
    shown = F.concat(F.regexp_replace(F.format_number(F.floor(pence / 100), 0), "x", ""), F.lit("."), F.lpad((pence % 100).cast("string"), 2, "0"))
    signed = F.when(k == 0, F.concat(F.lit("£"), shown)).when(k == 1, F.concat(F.lit("-"), shown)).when(k == 2, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.concat(shown, F.lit("-")))
    text = F.concat(F.lit("ref: "), signed, F.lit(" v1.2.3 12/05/2024 x9.999 "), shown)
    own = table(spark, sf_dir, "orders").select("o_orderkey", printed_figures(text).alias("f"), figures(text).alias("p"))
    return own.select("o_orderkey", *[F.col("f")[0][c].alias(c) for c in ("start", "end", "pence", "negative")], F.col("p")[1].alias("second"))


@query(with_sql(MOVEMENT) + "SELECT id, substr(sha256(account_id || '|' || strftime(date, '%Y-%m-%d') || '|' || CASE WHEN amount_pence < 0 THEN '-' ELSE '' END || (abs(amount_pence) // 100) || '.' || lpad(CAST(abs(amount_pence) % 100 AS VARCHAR), 2, '0') || '|' || lower(text) || '|' || (id % 3)), 1, 24) AS fingerprint FROM movement")
def F7_fingerprint(spark, sf_dir):
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t ")))
    return movements(spark, sf_dir).select("id", fingerprint(F.col("account_id"), F.col("date"), F.col("amount_pence"), spaced, F.col("id") % 3).alias("fingerprint"))


@query(with_sql(MOVEMENT) + "SELECT id, upper(text) || ' 12 MAIN ST' AS cleaned, CASE WHEN id % 2 = 0 THEN 'CORNER #' ELSE regexp_replace(upper(text), '[0-9]+', '#', 'g') || ' # MAIN ST' END AS printed FROM movement")
def F9_variants(spark, sf_dir):
    raw = F.concat(F.lower("text"), F.lit("  12 Main  St "))
    return movements(spark, sf_dir).select("id", clean(raw).alias("cleaned"), variant(raw, F.when(F.col("id") % 2 == 0, "Corner 77")).alias("printed"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part")
def F11_display_names(spark, sf_dir):
    raw = F.concat(F.lit("CARD PAYMENT TO "), F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, " LTD LONDON").otherwise(" ON 12 MAR"))
    return table(spark, sf_dir, "part").select("p_partkey", display_name(raw).alias("name"))


_PARTS = "string_split(c.id, '.')"


@query(with_sql(CATEGORY) + f"""SELECT c.id, (SELECT string_agg(a.label, ' › ' ORDER BY a.level) FROM category a WHERE a.id = c.id OR c.id LIKE a.id || '.%') AS path, t.kind, (SELECT count(*) FROM category d WHERE d.parent_id = c.id) AS children,
    CASE WHEN len({_PARTS}) >= 2 THEN array_to_string({_PARTS}[1:2], '.') END AS second FROM category c JOIN category t ON t.id = {_PARTS}[1]""")
def F13_tree(spark, sf_dir):
    return spending.paths(categories(spark, sf_dir)).select("id", "path", "kind", "children", spending.ancestor_at(F.col("id"), 2).alias("second"))


@query("""WITH x AS (SELECT c_custkey, DATE '2023-01-01' + CAST(c_custkey % 400 AS INTEGER) AS d, CAST(c_custkey % 12 + 1 AS INTEGER) AS m FROM customer),
    h AS (SELECT *, unnest(range(1, 14)) AS k FROM x), dated AS (SELECT *, CAST(date_trunc('month', d) + to_months(CAST(k AS INTEGER)) AS DATE) AS first FROM h)
    SELECT c_custkey, min(first + CAST(least(day(d), day(last_day(first))) - 1 AS INTEGER)) AS next_due FROM dated WHERE month(first) NOT IN (m, m % 12 + 1) GROUP BY c_custkey""")
def F15_due_past_skipped_months(spark, sf_dir):
    k = F.col("c_custkey")
    x = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(F.lit("2023-01-01").cast("date"), (k % 400).cast("int")).alias("d"), (k % 12 + 1).cast("int").alias("m"))
    return x.select("c_custkey", next_due(F.col("d"), F.lit("monthly"), F.day("d"), F.array("m", (F.col("m") % 12 + 1).cast("int"))).alias("next_due"))


@query(with_sql(MOVEMENT) + "SELECT id, array_to_string(list_filter(['TRANSFER', 'TFR', 'SAVINGS', 'SAVER', 'POT', 'ISA', 'OWN ACCOUNT', 'INTERNAL', 'PAYMENT RECEIVED', 'THANK YOU', 'CARD REPAYMENT', 'MOBILE PAYMENT'], lambda w: regexp_matches(text || ' POT-HOLE SAVINGSX', '\\b' || w || '\\b')), ',') AS words FROM movement")
def F31_transfer_words(spark, sf_dir):
    return movements(spark, sf_dir).select("id", F.array_join(matching.transfer_words(F.concat("text", F.lit(" POT-HOLE SAVINGSX"))), ",").alias("words"))


@query(with_sql(MOVEMENT) + "SELECT id, starts_with(text, 'SHOP') AS shop, text = 'TRANSFER TO REF7' AS whole, false AS inside, false AS none FROM movement")
def P10_phrases(spark, sf_dir):
    said = lambda phrase: phrase_in(F.lit(phrase), F.concat(F.lit("x-"), F.col("text"), F.lit(".y")))
    return movements(spark, sf_dir).select("id", said("shop").alias("shop"), said("transfer  to/ref7").alias("whole"), said("ho").alias("inside"), said(" - ").alias("none"))


@query(with_sql(LEDGER) + "SELECT id, n AS new_by, n = 'human' OR (status <> 'confirmed' AND a >= authority) AS may FROM ledger, (VALUES ('human', 100), ('rule', 80), ('model', 40)) v(n, a)")
def P12_authority_gate(spark, sf_dir):
    new = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a")) for n, a in (("human", 100), ("rule", 80), ("model", 40))]))
    return ledger(spark, sf_dir).withColumn("v", new).select("id", F.col("v.n").alias("new_by"), understanding.may_replace(F.col("status"), F.col("authority"), F.col("v.n"), F.col("v.a")).alias("may"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_brand || ' ' || p_name || ' ' || p_type, ' ')) AS b, string_split('cold heavy widget', ' ') AS c FROM part)
    SELECT p_partkey, true AS within, len(list_intersect(a, c)) IN (len(a), len(c)) OR 2 * len(list_intersect(a, c)) >= len(list_distinct(list_concat(a, c))) AS alike FROM w""")
def U4_set_tests(spark, sf_dir):
    a, b, c = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_brand", "p_name", "p_type"), " "), F.array(*map(F.lit, ("cold", "heavy", "widget")))
    return table(spark, sf_dir, "part").select("p_partkey", similar_tokens(F.array_distinct(a), F.array_distinct(b)).alias("within"), similar_tokens(F.array_distinct(a), c).alias("alike"))


# Rules and categories

_RULE = "('r1', NULL, 'SHOP', 500, NULL, NULL, NULL, NULL), ('r2', 3, NULL, NULL, 90000, NULL, 'out', NULL), ('r3', NULL, NULL, NULL, NULL, 5, NULL, '2024-01-10'), ('r4', NULL, 'REF7', NULL, NULL, NULL, 'in', NULL)"


@query(with_sql(MOVEMENT) + f""", rule AS (SELECT * FROM (VALUES {_RULE}) v(rule_id, merchant_id, phrase, min_pence, max_pence, account_id, direction, date_from))
    SELECT m.id, r.rule_id FROM (SELECT *, id % 9 AS merchant_id FROM movement) m JOIN rule r ON (r.merchant_id IS NULL OR r.merchant_id = m.merchant_id) AND (r.phrase IS NULL OR contains(' ' || m.text || ' ', ' ' || r.phrase || ' '))
        AND (r.min_pence IS NULL OR abs(m.amount_pence) >= r.min_pence) AND (r.max_pence IS NULL OR abs(m.amount_pence) <= r.max_pence) AND (r.account_id IS NULL OR r.account_id = m.account_id)
        AND (r.direction IS NULL OR (r.direction = 'in') = (m.amount_pence > 0)) AND (r.date_from IS NULL OR m.date >= CAST(r.date_from AS DATE))""")
def P9_rule_predicate(spark, sf_dir):
    rows = [("r1", None, "shop", 500, None, None, None, None), ("r2", 3, None, None, 90000, None, "out", None), ("r3", None, None, None, None, 5, None, "2024-01-10"), ("r4", None, "ref7", None, None, None, "in", None)]
    own = spark.createDataFrame(rows, "rule_id string, merchant_id bigint, phrase string, min_pence bigint, max_pence bigint, account_id bigint, direction string, date_from string")
    own = own.select("*", F.lit(None).cast("date").alias("date_to"), F.lit(None).cast("string").alias("who")).withColumn("date_from", F.col("date_from").cast("date"))
    moves = movements(spark, sf_dir).withColumn("merchant_id", F.col("id") % 9).withColumn("who", F.lit("household"))
    return moves.alias("t").join(F.broadcast(own.alias("r")), rules.matches("r", "t")).select("t.id", "r.rule_id")  # four rules


@query(with_sql(LEDGER) + "SELECT id, coalesce(category_id = 'asia' OR category_id LIKE 'asia.%', false) AS below, category_id IS NULL AND amount_pence < 0 AS unsorted FROM ledger")
def P8_subtree(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", F.coalesce(spending.in_subtree("category_id", "asia"), F.lit(False)).alias("below"), spending.is_unsorted().alias("unsorted"))


@query(with_sql(LEDGER) + """, k(prefix, kind) AS (VALUES ('asia', 'bill'), ('asia.nation-2', 'subscription'), ('africa', 'other'), ('europe.nation-3.building', 'loan'))
    SELECT l.id, (SELECT arg_max(k.kind, length(k.prefix)) FROM k WHERE l.category_id = k.prefix OR l.category_id LIKE k.prefix || '.%') AS kind FROM ledger l""")
def F29_kind_by_prefix(spark, sf_dir):
    kinds = spark.createDataFrame([("asia", "bill"), ("asia.nation-2", "subscription"), ("africa", "other"), ("europe.nation-3.building", "loan")], "prefix string, kind string")
    return accounts.kind_of_category(ledger(spark, sf_dir), kinds).select("id", "kind")


# People, banks, profiles


@query("""WITH p AS (SELECT c_nationkey AS household, c_custkey AS pos, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'adult' WHEN 1 THEN 'child' WHEN 2 THEN 'adult' ELSE 'lodger' END AS role FROM customer),
    n AS (SELECT *, CASE WHEN role IN ('adult', 'child') THEN role ELSE 'dependant' END AS g, row_number() OVER (PARTITION BY household, CASE WHEN role IN ('adult', 'child') THEN role ELSE 'dependant' END ORDER BY pos) AS k FROM p)
    SELECT household, name, CASE g WHEN 'adult' THEN 'Adult ' || chr(CAST(65 + (k - 1) % 26 AS INTEGER)) WHEN 'child' THEN 'Child ' || k ELSE 'Dependant ' || k END AS label FROM n""")
def F40_role_labels(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.when(k % 2 == 0, "adult").when(k % 4 == 1, "child").otherwise("lodger")
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("household"), k.alias("pos"), F.col("c_name").alias("name"), role.alias("role"))
    again = people.select("household", (F.col("pos") + 10_000_000).alias("pos"), F.upper("name").alias("name"), F.lit("adult").alias("role"))  # the same person, once more
    return accounts.role_labels(people.unionByName(again), "household").select("household", "name", "label")


@query(with_sql(LEDGER) + "SELECT id, CASE WHEN who = 'p0' THEN 'p0' WHEN who = 'p1' THEN 'p1' ELSE 'household' END AS who, CASE WHEN confidence >= 0.8 THEN 'inferred' ELSE 'low_confidence' END AS status FROM ledger")
def F36_default_who(spark, sf_dir):
    owners = F.when(F.col("who").isin("p0", "p1"), F.array("who")).otherwise(F.array(F.lit("p0"), F.lit("p1")))
    return ledger(spark, sf_dir).select("id", accounts.default_who(owners).alias("who"), accounts.status_for(F.col("confidence")).alias("status"))


@query("""WITH b AS (SELECT c_custkey AS k, lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code, 'BANKGB' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') AS bic FROM customer),
    six AS (SELECT lpad(CAST((n_nationkey * 7919 * 3) % 1000000 AS VARCHAR), 6, '0') AS prefix, n_name AS provider FROM nation), two AS (SELECT lpad(CAST(n_nationkey * 2 AS VARCHAR), 2, '0') AS prefix, 'two ' || n_name AS provider FROM nation),
    bics AS (SELECT 'BANKGB' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS bic, 'bic ' || n_name AS provider FROM nation),
    f AS (SELECT k, CASE WHEN k % 2 = 0 THEN coalesce(six.provider, two.provider) END AS by_code, bics.provider AS by_bic, CASE WHEN k % 5 = 0 THEN 'Second Bank' WHEN k % 5 = 1 THEN 'First Bank' END AS by_text FROM b LEFT JOIN six ON b.code = six.prefix LEFT JOIN two ON b.code[1:2] = two.prefix LEFT JOIN bics USING (bic))
    SELECT k, coalesce(by_code, by_bic, by_text) AS provider, CASE WHEN by_code IS NOT NULL THEN 'sort code' WHEN by_bic IS NOT NULL THEN 'bic' WHEN by_text IS NOT NULL THEN 'text' END AS told_by FROM f""")
def P20_bank(spark, sf_dir):
    k, six = F.col("c_custkey"), lambda n: F.lpad((n % 1_000_000).cast("string"), 6, "0")
    code = six(k * 7919)
    dashed = F.concat_ws("-", F.substring(code, 1, 2), F.substring(code, 3, 2), F.substring(code, 5, 2))
    text = F.when(k % 5 == 0, "Statement\nSECOND BANK plc").when(k % 5 == 1, "First Bank, not Second Bank").otherwise("none")
    own = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 2 == 0, dashed).otherwise("123").alias("bank_id"), F.concat(F.lit("bankgb"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("XXX")).alias("bic"), text.alias("text"))
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    codes = n.select(six(key * 7919 * 3).alias("prefix"), F.col("n_name").alias("provider")).unionByName(n.select(F.lpad((key * 2).cast("string"), 2, "0").alias("prefix"), F.concat(F.lit("two "), "n_name").alias("provider")))
    bics = n.select(F.concat(F.lit("BANKGB"), F.lpad(key.cast("string"), 2, "0")).alias("bic"), F.concat(F.lit("bic "), "n_name").alias("provider"))
    markers = spark.createDataFrame([("first bank", 1, "First Bank"), ("Second Bank", 2, "Second Bank")], "needle string, rank int, provider string")
    return accounts.bank_of(own, codes, bics, markers, "k")


@query(with_sql(MOVEMENT) + """, a AS (SELECT account_id, CASE account_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'credit_card' ELSE 'savings' END AS kind, count(*) FILTER (amount_pence > 0 AND text LIKE 'REFUND%') AS agree, count(*) FILTER (amount_pence < 0 AND text LIKE 'REFUND%' AND id % 40 = 0) AS disagree FROM movement GROUP BY 1)
    SELECT account_id, CASE WHEN account_id % 7 = 0 THEN NULL WHEN kind <> 'credit_card' THEN CASE WHEN account_id % 2 = 0 THEN 'account' END WHEN account_id % 5 = 0 THEN NULL WHEN disagree > 0 THEN 'rows' WHEN agree = 0 AND account_id % 4 = 0 THEN 'no evidence' END AS sign_doubt,
        account_id % 11 <> 0 AND (kind = 'credit_card') <> (account_id % 2 = 0) AS kind_doubt FROM a""")
def D14_doubts(spark, sf_dir):
    k, refund = F.col("account_id"), F.startswith("text", F.lit("REFUND"))
    kind = F.when(k % 3 == 0, "current").when(k % 3 == 1, "credit_card").otherwise("savings")
    evidence = movements(spark, sf_dir).groupBy("account_id").agg(F.count_if((F.col("amount_pence") > 0) & refund).alias("agree"), F.count_if((F.col("amount_pence") < 0) & refund & (F.col("id") % 40 == 0)).alias("disagree"))
    sign = accounts.sign_doubt(k % 7 != 0, kind, F.when(k % 2 == 0, "card").otherwise("household"), k % 5 == 0, F.col("agree"), F.col("disagree"), k % 4 == 0)
    said = F.when(k % 11 == 0, None).when(k % 2 == 0, "credit_card").otherwise("current")
    return evidence.select("account_id", sign.alias("sign_doubt"), accounts.kind_doubt(said, kind).alias("kind_doubt"))


@query("SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 AND CAST(o_orderdate AS DATE) + 3500 BETWEEN DATE '2007-04-06' AND DATE '2024-11-01' AS flagged FROM orders")
def P16_window_flag(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "car finance").otherwise("loan")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), accounts.redress(kind, F.col("o_orderkey") % 2 == 0, F.date_add(F.col("o_orderdate").cast("date"), 3500)).alias("flagged"))


@query("SELECT c_nationkey, CAST(round_even(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 0) AS BIGINT) AS percent, coalesce(string_agg(c_name, ',' ORDER BY c_name) FILTER (c_acctbal <= 0), '') AS unmet FROM customer GROUP BY 1")
def P17_completeness(spark, sf_dir):
    checks = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("check"), (F.col("c_acctbal") > 0).alias("met"))
    return accounts.completeness(checks, "c_nationkey").select("c_nationkey", "percent", F.array_join("unmet", ",").alias("unmet"))


@query(with_sql(MOVEMENT) + """, p AS (SELECT account_id, date AS a, date + 2 AS b FROM movement WHERE id % 25 = 0) SELECT id FROM movement m WHERE EXISTS (SELECT 1 FROM p WHERE p.account_id = m.account_id AND m.date BETWEEN p.a - 1 AND p.b + 1)""")
def P15_covered_rows(spark, sf_dir):
    moves = movements(spark, sf_dir)
    periods = moves.where("id % 25 = 0").select("account_id", F.col("date").alias("start"), F.date_add("date", 2).alias("end"))
    return accounts.covered(moves, periods, ["account_id"], 1).select("id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN 'LS' || (s_suppkey % 20) || CASE WHEN s_suppkey % 20 < 10 AND s_suppkey % 5 = 1 THEN 'W' ELSE '' END END AS district FROM supplier")
def F19_district(spark, sf_dir):
    k = F.col("s_suppkey")
    n = (k % 20).cast("string")
    given = F.when(k % 5 == 3, F.concat(F.lit("LS"), n, F.lit(" 9ZZ"))).when(k % 5 == 4, n).when((k % 5 == 1) & (k % 20 < 10), F.concat(F.lit(" l s"), n, F.lit("w "))).otherwise(F.concat(F.lit(" ls"), n, F.lit(" ")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", accounts.district(given).alias("district"))


# What was decided, and why

_WHY_FROM = """, m AS (SELECT s_suppkey AS merchant_id, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'asia' END AS usual, s_suppkey % 9 AS seen FROM supplier WHERE s_suppkey % 4 <> 0), l AS (SELECT *, CASE WHEN decided_by = 'model' AND id % 2 = 0 THEN 'memory' ELSE decided_by END AS by_, CASE WHEN id % 6 = 0 THEN id + 1 END AS partner_id FROM ledger)"""


@query(with_sql(LEDGER, CATEGORY) + _WHY_FROM + """ SELECT l.id, concat_ws(' ', CASE by_ WHEN 'human' THEN 'You decided it.' WHEN 'rule' THEN CASE WHEN l.id % 10 < 6 THEN CASE WHEN l.id % 10 % 2 = 0 THEN 'Matched the built-in rule ' ELSE 'Matched your rule ' END || 'rule ' || (l.id % 10) || '.' END
        WHEN 'memory' THEN 'Seen ' || m.s_name || ' ' || m.seen || ' times' || coalesce(', usually ' || c.label, '') || '.' WHEN 'model' THEN 'A guess, ' || CAST(round_even(l.confidence * 100, 0) AS INTEGER) || '% sure.' END,
        'Matched with account ' || (o.o_custkey) || ' on ' || strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y') || '.', CASE WHEN ignored THEN 'It is left out.' END) AS why
    FROM l LEFT JOIN m ON m.merchant_id = l.merchant_id LEFT JOIN category c ON c.id = m.usual LEFT JOIN orders o ON o.o_orderkey = l.partner_id""")
def J20_why(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("decided_by", F.when((F.col("decided_by") == "model") & (F.col("id") % 2 == 0), "memory").otherwise(F.col("decided_by"))).withColumn("rule_id", F.col("id") % 10).withColumn("partner_id", F.when(F.col("id") % 6 == 0, F.col("id") + 1))
    rule_table = spark.range(6).select(F.col("id").alias("rule_id"), F.concat(F.lit("rule "), F.col("id").cast("string")).alias("description"), F.when(F.col("id") % 2 == 0, "seed").otherwise("person").alias("source"))
    k = F.col("s_suppkey")
    merchants = table(spark, sf_dir, "supplier").where(k % 4 != 0).select(k.alias("merchant_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "asia").alias("usual_category"), (k % 9).alias("seen"))
    partners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("partner_id"), F.concat(F.lit("account "), F.col("o_custkey").cast("string")).alias("nickname"), F.col("o_orderdate").cast("date").alias("partner_date"))
    return accounts.why(rows, rule_table, merchants, categories(spark, sf_dir), partners)


@query(with_sql(LEDGER) + "SELECT id, concat_ws(' ', CASE decided_by WHEN 'human' THEN 'You decided it.' WHEN 'model' THEN 'A guess, ' || CAST(round_even(confidence * 100, 0) AS INTEGER) || '% sure.' END, CASE WHEN ignored THEN 'It is left out.' END) AS why FROM ledger")
def F34_why(spark, sf_dir):
    """The steps that need nothing but the row: rules, merchants and partners are all gone."""
    rows = ledger(spark, sf_dir).withColumn("rule_id", F.lit(None).cast("bigint")).withColumn("partner_id", F.lit(None).cast("bigint"))
    gone = lambda shape: spark.createDataFrame([], shape)
    return accounts.why(rows, gone("rule_id bigint, description string, source string"), gone("merchant_id bigint, name string, usual_category string, seen bigint"), categories(spark, sf_dir), gone("partner_id bigint, nickname string, partner_date date"))


@query(with_sql(LEDGER) + """, c AS (SELECT account_id, count(*) FILTER (decided_by = 'rule') AS r, count(*) FILTER (decided_by = 'human') AS m, count(*) FILTER (decided_by = 'model') AS l, count(*) FILTER (status = 'unknown') AS w, count(*) FILTER (ignored) AS p FROM ledger GROUP BY 1),
    s AS (SELECT account_id, concat_ws(' ', CASE WHEN r + m + l > 0 THEN 'Sorted ' || (r + m + l) || CASE WHEN r + m + l = 1 THEN ' transaction' ELSE ' transactions' END || ' (' || concat_ws(', ', CASE WHEN r > 0 THEN r || ' by your rules' END, CASE WHEN m > 0 THEN m || ' from memory' END, CASE WHEN l > 0 THEN l || ' by the model' END) || ').' END,
        CASE WHEN p > 0 THEN 'Matched ' || p || CASE WHEN p = 1 THEN ' transfer.' ELSE ' transfers.' END END, CASE WHEN w > 0 THEN w || CASE WHEN w = 1 THEN ' transaction' ELSE ' transactions' END || ' will be tried again next run.' END) AS t FROM c)
    SELECT account_id, CASE WHEN t = '' THEN 'Nothing new to sort.' ELSE t END AS summary FROM s""")
def F35_run_summary(spark, sf_dir):
    n = lambda when: F.count_if(when)
    counts = ledger(spark, sf_dir).groupBy("account_id").agg(n(F.col("decided_by") == "rule").alias("by_rule"), n(F.col("decided_by") == "human").alias("by_memory"), n(F.col("decided_by") == "model").alias("by_model"), n(F.col("status") == "unknown").alias("waiting"), n(F.col("ignored")).alias("pairs"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("second_looks", "found", "rises")]
    return accounts.run_summary(counts.select("*", *none), "account_id")


@query(with_sql(LEDGER) + """, d AS (SELECT merchant_id, split_part(category_id, '.', 1) AS c, abs(amount_pence) AS pence FROM ledger WHERE category_id IS NOT NULL AND decided_by IN ('human', 'model')),
    b AS (SELECT merchant_id, c, count(*) AS n, sum(pence) AS p FROM d GROUP BY 1, 2), g AS (SELECT merchant_id, c, n, sum(n) OVER (PARTITION BY merchant_id) AS s, row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, p DESC, c) AS k FROM b),
    guess AS (SELECT merchant_id, c FROM g WHERE k = 1 AND s >= 3 AND n / s >= 0.25), ch AS (SELECT s_suppkey AS merchant_id, c FROM supplier JOIN guess ON merchant_id = s_suppkey WHERE s_suppkey % 5 <> 0 AND c IS DISTINCT FROM CASE WHEN s_suppkey % 2 = 0 THEN 'asia' END)
    SELECT l.id, 99 AS knowledge_version FROM ledger l JOIN ch ON ch.merchant_id = l.merchant_id AND ch.c = split_part(l.category_id, '.', 1) WHERE l.status <> 'confirmed'""")
def D5_remember(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("category_id", F.substring_index("category_id", ".", 1))
    decided = rows.where("category_id IS NOT NULL AND decided_by IN ('human', 'model')").select("merchant_id", "category_id", "who", "confidence", F.abs("amount_pence").alias("pence"))
    guesses = understanding.infer_memory(decided, 3, 0.25).select("merchant_id", "category_id", "confidence", F.col("rows").alias("seen"))
    k = F.col("s_suppkey")
    merchants = table(spark, sf_dir, "supplier").select(k.alias("merchant_id"), F.when(k % 2 == 0, "asia").alias("usual_category"), F.when(k % 5 == 0, "confirmed").alias("memory"), F.lit(0.5).alias("confidence"), F.lit(0).cast("bigint").alias("seen"))
    return accounts.remembered(merchants, guesses, rows, 99)[1]


@query("""WITH e AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'monthly' ELSE 'weekly' END AS cadence, c_custkey * 10 AS a, 'active' AS s, CASE WHEN c_custkey % 4 = 0 THEN ['trial'] ELSE [] END AS f FROM customer WHERE c_custkey % 7 <> 0),
    g AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'monthly' ELSE 'weekly' END AS cadence, c_custkey * 10 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN c_custkey % 8 = 1 THEN 'lapsed' ELSE 'active' END AS s, CASE WHEN c_custkey % 8 = 0 THEN ['trial', 'price rise'] ELSE ['price rise'] END AS f FROM customer WHERE c_custkey % 11 <> 0),
    b AS (SELECT coalesce(e.k, g.k) AS k, e.k IS NULL AS no_e, g.k IS NULL AS no_g, concat_ws(',', CASE WHEN e.cadence <> g.cadence THEN 'cadence' END, CASE WHEN e.a <> g.a THEN 'amount_pence' END, CASE WHEN e.s <> g.s THEN 'status' END, CASE WHEN len(list_filter(e.f, lambda x: NOT list_contains(g.f, x))) > 0 THEN 'flags' END) AS d FROM e FULL JOIN g ON e.k = g.k)
    SELECT k, CASE WHEN no_e THEN 'extra' WHEN no_g THEN 'missing' WHEN d = '' THEN 'ok' ELSE 'wrong' END AS verdict, CASE WHEN no_e OR no_g THEN '' ELSE d END AS differs FROM b""")
def A25_commitment_scores(spark, sf_dir):
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    e = c.where(k % 7 != 0).select(k.alias("k"), F.when(k % 3 == 0, "monthly").otherwise("weekly").alias("cadence"), (k * 10).alias("amount_pence"), F.lit("active").alias("status"), F.when(k % 4 == 0, F.array(F.lit("trial"))).otherwise(none).alias("flags"))
    rise = F.array(F.lit("price rise"))
    f = c.where(k % 11 != 0).select(k.alias("k"), F.when(k % 6 == 0, "monthly").otherwise("weekly").alias("cadence"), (k * 10 + (k % 5 == 0).cast("int")).alias("amount_pence"), F.when(k % 8 == 1, "lapsed").otherwise("active").alias("status"), F.when(k % 8 == 0, F.concat(F.array(F.lit("trial")), rise)).otherwise(rise).alias("flags"))
    return accounts.commitment_scores(e, f, ["k"])


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'click') AS inserted, count(*) FILTER (event_type = 'purchase') AS exact, count(*) FILTER (event_type = 'signup') AS similar, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY 1")
def A22_upload_counts(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("click", "new", "purchase", "exact", "signup", "similar", "error", "skipped")])
    return accounts.upload_counts(table(spark, sf_dir, "events").select("user_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("match")), "user_id")


@query(with_sql(MOVEMENT) + """, e AS (SELECT account_id, id % 100 AS n, CASE WHEN id % 4 = 0 THEN 'L' || (id % 100) || ': ' || text ELSE text END AS error, id % 4 = 0 AND EXISTS (SELECT 1 FROM movement o WHERE o.account_id = m.account_id AND o.id % 50 = m.id % 100) AS own FROM movement m)
    SELECT account_id, CASE WHEN own THEN 'L' || n ELSE 'general' END AS ref, count(*) AS n, min(error) AS first FROM e GROUP BY 1, 2""")
def A27_errors_by_line(spark, sf_dir):
    moves = movements(spark, sf_dir)
    error = F.when(F.col("id") % 4 == 0, F.concat(F.lit("L"), (F.col("id") % 100).cast("string"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    lines = moves.select("account_id", F.concat(F.lit("L"), (F.col("id") % 50).cast("string")).alias("ref"))
    return accounts.errors_by_line(moves.select("account_id", error.alias("error")), lines, "account_id")


@query(with_sql(MOVEMENT) + """, c AS (SELECT account_id, id % 10 AS chunk, count(*) AS n, min(date) AS a, max(date) AS b, CASE WHEN id % 10 IN (1, 2) THEN min(id) END AS o, CASE WHEN id % 10 IN (3, 5) THEN max(id) END AS z FROM movement GROUP BY 1, 2)
    SELECT account_id, CAST(sum(n) AS BIGINT) AS n, min(a) AS period_start, max(b) AS period_end, arg_min(o, chunk) FILTER (o IS NOT NULL) AS opening_pence, arg_max(z, chunk) FILTER (z IS NOT NULL) AS closing_pence FROM c GROUP BY 1""")
def U5_chunk_merge(spark, sf_dir):
    c = F.col("id") % 10
    chunks = movements(spark, sf_dir).groupBy("account_id", c.alias("chunk")).agg(F.count("*").alias("n"), F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    told = chunks.select("*", F.when(F.col("chunk").isin(1, 2), F.col("lo")).alias("opening_pence"), F.when(F.col("chunk").isin(3, 5), F.col("hi")).alias("closing_pence"))
    return accounts.merged_chunks(told, "account_id")


@query(with_sql(MOVEMENT) + "SELECT account_id, id AS ref, 'D' || row_number() OVER (PARTITION BY account_id ORDER BY date, id) AS alias, id AS back FROM movement WHERE id % 3 <> 0")
def F39_aliases(spark, sf_dir):
    own = accounts.line_aliases(movements(spark, sf_dir).where("id % 3 <> 0").select("account_id", "date", F.col("id").alias("ref")), "account_id", "date", "ref")
    back = accounts.unaliased(own.select("account_id", "alias"), own.select("account_id", "alias", "ref"), "account_id", "ref").select("account_id", "alias", F.col("ref").alias("back"))
    return own.select("account_id", "ref", "alias").join(back, ["account_id", "alias"])


# Personal data

_CARDS = ("4111 1111 1111 1111", "4012-8888-8888-1881", "4111 1111 1111 1112")
_SECRET = "t AS (SELECT c_custkey AS k, list_value('4111 1111 1111 1111', '4012-8888-8888-1881', '4111 1111 1111 1112')[CAST(c_custkey % 3 + 1 AS INTEGER)] AS card, 'c' || c_custkey || '@mail.org' AS mail, lower(c_name) AS name FROM customer)"


def _secret(spark, sf_dir):
    k = F.col("c_custkey")
    card, mail = F.element_at(F.array(*map(F.lit, _CARDS)), (k % 3 + 1).cast("int")), F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.org"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), card.alias("card"), mail.alias("mail"), F.lower("c_name").alias("name"))


@query(with_sql(_SECRET) + "SELECT k, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'card' END, CASE WHEN k % 10 = 0 THEN 'iban' END, CASE WHEN k % 3 = 0 THEN 'sort_code' END, CASE WHEN k % 4 = 1 THEN 'email' END, CASE WHEN k % 7 = 0 THEN 'postcode' END, CASE WHEN k % 11 = 0 THEN 'national_insurance' END) AS kinds FROM t")
def F21_classes(spark, sf_dir):
    k = F.col("k")
    parts = [F.when(k % 2 == 0, F.col("card")), F.when(k % 10 == 0, "GB82 WEST 1234 5698 7654 32"), F.when(k % 3 == 0, "sort 12-34-56"), F.when(k % 4 == 1, F.col("mail")), F.when(k % 7 == 0, "at LS1 4AP"), F.when(k % 11 == 0, "AB 12 34 56 C")]
    return _secret(spark, sf_dir).select("k", F.array_join(sensitive_classes(F.concat_ws(" ; ", F.lit("Paid on 3 May"), *parts)), ",").alias("kinds"))


_STATEMENT = """v AS (SELECT c_custkey AS k, c_custkey // 8 AS statement, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS four, lead(c_custkey) OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) AS next FROM customer),
    line AS (SELECT k, statement, unnest([
        {'case': 0, 'text': '02 Oct 2026 SHOP ' || k || '.50', 'sent': '02 Oct 2026 SHOP ' || k || '.50', 'kinds': ''},
        {'case': 1, 'text': 'paid 4111.1111.1111.1111 to J. SMITH', 'sent': 'paid [hidden-a] to [hidden-b]', 'kinds': 'holder_name'},
        {'case': 2, 'text': 'Sort code 12-34-56 Account number 8765' || four, 'sent': 'Sort code [hidden-a] Account number [hidden-b]', 'kinds': 'account_label,sort_code_label,sort_code'},
        {'case': 3, 'text': 'Available balance £' || k || '.00', 'sent': NULL, 'kinds': 'balance_line'},
        {'case': 4, 'text': 'mail c' || k || '@mail.org £250', 'sent': 'mail [hidden-a] £250', 'kinds': 'email'},
        {'case': 5, 'text': 'FPO REF ' || four || ' 12.00', 'sent': 'FPO REF ' || CASE WHEN next IS NULL THEN four ELSE '[hidden-a]' END || ' 12.00', 'kinds': ''},
        {'case': 6, 'text': four || ' RENT 12.00', 'sent': '[hidden-a] RENT 12.00', 'kinds': ''},
        {'case': 7, 'text': 'Name: Alex ' || four, 'sent': 'Name: [hidden-a]', 'kinds': 'holder_label'}]) AS o FROM v)"""


def _statement(spark, sf_dir):
    """Eight lines a statement, one of each kind; a number is cut in two by the end of the sixth."""
    k, four = F.col("c_custkey"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    texts = [
        F.concat(F.lit("02 Oct 2026 SHOP "), k, F.lit(".50")), F.lit("paid 4111.1111.1111.1111 to J. SMITH"), F.concat(F.lit("Sort code 12-34-56 Account number 8765"), four), F.concat(F.lit("Available balance £"), k, F.lit(".00")),
        F.concat(F.lit("mail c"), k, F.lit("@mail.org £250")), F.concat(F.lit("FPO REF "), four, F.lit(" 12.00")), F.concat(four, F.lit(" RENT 12.00")), F.concat(F.lit("Name: Alex "), four),
    ]
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.floor(k / 8).alias("statement"), F.element_at(F.array(*texts), (k % 8 + 1).cast("int")).alias("text"))


@query(with_sql(_STATEMENT) + "SELECT k, o.kinds AS kinds, o.sent AS sent, o.sent IS NULL AS refused FROM line WHERE o.\"case\" = k % 8")
def F22_outbound(spark, sf_dir):
    """What may leave of statement lines: kinds told, numbers wrapped over a line's end, balances refused."""
    found = privacy.prepared(_statement(spark, sf_dir), "statement", "k", names=F.array(F.lit("John Smith")))
    return found.select("k", F.array_join("kinds", ",").alias("kinds"), F.col("outbound").alias("sent"), F.col("outbound").isNull().alias("refused"))


@query(with_sql(_SECRET) + """, c AS (SELECT *, CASE WHEN k % 3 < 2 THEN '[CARD_1]' ELSE card END AS shown FROM t)
    SELECT k, 'From [EMAIL_1], card ' || shown AS first, 'again ' || shown || ', [EMAIL_1] to [EMAIL_2]' AS second, 'again ' || card || ', ' || mail || ' to x@y.org' AS back FROM c""")
def F23_redaction(spark, sf_dir):
    """One token a value through both lines, and the second line put back; a number that is no card stays."""
    own = _secret(spark, sf_dir)
    first = own.select("k", F.lit(1).alias("pos"), F.concat(F.lit("From "), "mail", F.lit(", card "), "card").alias("text"))
    second = own.select("k", F.lit(2).alias("pos"), F.concat(F.lit("again "), "card", F.lit(", "), F.upper("mail"), F.lit(" to x@y.org")).alias("text"))
    hidden, mapping = redaction.redacted(first.unionByName(second), "k")
    line = lambda n, name: hidden.where(F.col("pos") == n).select("k", F.col("text").alias(name))
    back = redaction.put_back(line(2, "text"), mapping, "k").select("k", F.col("text").alias("back"))
    return line(1, "first").join(line(2, "second"), "k").join(back, "k")


_PEOPLE = """m AS (SELECT c_custkey AS k, c_custkey // 4 AS household, c_custkey % 4 AS n, translate(CAST(c_custkey // 4 AS VARCHAR), '0123456789', 'abcdefghij') AS tail FROM customer),
    p AS (SELECT *, list_value('Ada', 'Bob', 'Cyd', 'Dee')[CAST(n + 1 AS INTEGER)] AS first, row_number() OVER (PARTITION BY household ORDER BY k) AS card, row_number() OVER (PARTITION BY household, n % 2 ORDER BY k) AS adult FROM m),
    t AS (SELECT *, CASE WHEN n % 2 = 0 THEN '[ADULT_' || chr(CAST(64 + adult AS INTEGER)) || ']' WHEN n = 1 THEN '[CHILD_1]' ELSE '[DEPENDANT_1]' END AS token, first || ' Quin' || tail AS whole FROM p)"""


@query(with_sql(_PEOPLE) + """SELECT k, 'Pay ' || token || $$'s rent, cc $$ || token || ' and bob quin' || tail || 'x: ' || CASE WHEN n = 1 THEN token ELSE 'will ' || lower(first) END || ' [CARD_' || card || '], [SORT_CODE_1] [ACCOUNT_1]' AS sent,
    'Pay ' || whole || $$'s rent, cc $$ || whole || ' and bob quin' || tail || 'x: ' || CASE WHEN n = 1 THEN whole ELSE 'will ' || lower(first) END || ' 4111.1111.1111.000' || n || ', 20 11 33 87654321' AS back FROM t""")
def F23_names(spark, sf_dir):
    """Names in several forms, one label a person through a household's lines, dotted cards and paired codes; and all put back."""
    k = F.col("c_custkey")
    n, household = k % 4, F.floor(k / 4)
    first = F.element_at(F.array(*map(F.lit, ("Ada", "Bob", "Cyd", "Dee"))), (n + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select(k.alias("k"), household.alias("household"), n.alias("n"), first.alias("first"), F.translate(household.cast("string"), "0123456789", "abcdefghij").alias("tail"))
    own = own.withColumn("last", F.concat(F.lit("Quin"), "tail"))
    role = F.when(F.col("n") % 2 == 0, "adult").when(F.col("n") == 1, "child").otherwise("lodger")
    people = own.select("household", F.col("k").alias("pos"), F.concat_ws(" ", "first", "last").alias("name"), role.alias("role"))
    single = F.when(F.col("n") == 1, F.upper("first")).otherwise(F.concat(F.lit("will "), F.lower("first")))
    text = F.concat(F.lit("Pay "), F.upper(F.concat_ws(" ", "first", "last")), F.lit("'s rent, cc "), F.concat_ws(". ", F.substring("first", 1, 1), "last"), F.lit(" and bob quin"), "tail", F.lit("x: "), single, F.lit(" 4111.1111.1111.000"), "n", F.lit(", 20 11 33 87654321"))
    hidden, mapping = redaction.pseudonymised(own.select("household", F.col("k").alias("pos"), text.alias("text")), people, "household")
    back = redaction.put_back(hidden, mapping, "household").select(F.col("pos").alias("k"), F.col("text").alias("back"))
    return hidden.select(F.col("pos").alias("k"), F.col("text").alias("sent")).join(back, "k")


# Pages and layouts

_FOLDED = "regexp_replace(lower(trim(regexp_replace(t.l, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g')"


@query(f"""WITH lines AS (SELECT doc_id % 10 AS book, doc_id AS page, {_FOLDED} AS line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) t),
    n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS a, row_number() OVER (PARTITION BY page ORDER BY pos DESC) AS z FROM lines WHERE line <> '')
    SELECT book, line, count(DISTINCT page) AS pages FROM n WHERE a <= 4 OR z <= 3 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""")
def S18_page_furniture(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("book"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return documents.edge_repeats(lines, "book", "page")


@query(with_sql(MOVEMENT) + """, l AS (SELECT account_id, id, text, row_number() OVER w - 1 AS n, last_value(CASE WHEN id % 7 = 0 THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM movement WINDOW w AS (PARTITION BY account_id ORDER BY id))
    SELECT id, CAST(n // 5 AS INTEGER) AS chunk, first_value(h) OVER (PARTITION BY account_id, n // 5 ORDER BY n) AS context FROM l""")
def S19_chunk_plan(spark, sf_dir):
    lines = movements(spark, sf_dir).select("account_id", F.col("id").alias("pos"), "text")
    return documents.chunk_plan(lines, "account_id", 5, F.col("pos") % 7 == 0).select(F.col("pos").alias("id"), "chunk", "context")


@query("SELECT doc_id, CAST(list_aggregate(list_transform([',', ';', chr(9), '|'], lambda d: len(text) - len(replace(text, d, ''))), 'max') AS INTEGER) AS marks FROM documents")
def S3_delimiter_counts(spark, sf_dir):
    counted = [F.length("text") - F.length(F.replace("text", F.lit(d), F.lit(""))) for d in (",", ";", "\t", "|")]
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(*counted).alias("marks"))


@query(with_sql(MOVEMENT) + "SELECT account_id, CASE account_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS mark FROM movement GROUP BY 1")
def S3_delimiter(spark, sf_dir):
    k = F.col("account_id")
    mark = F.when(k % 4 == 0, ",").when(k % 4 == 1, ";").when(k % 4 == 2, "\t").otherwise("|")
    line = F.concat_ws("~", F.date_format("date", "dd/MM/yyyy"), F.col("text"), F.lit("1 234"), F.lit("x"))
    texts = movements(spark, sf_dir).groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    return texts.select("account_id", delimited.delimiter(F.replace("t", F.lit("~"), mark)).alias("mark"))


@query(with_sql(MOVEMENT) + """, p AS (SELECT account_id AS file, count(*) AS n FROM movement GROUP BY 1) SELECT file, CASE WHEN file % 3 = 0 THEN 2 * n + 3 ELSE n + 3 END AS last_line, CAST(n AS BIGINT) AS data, CAST(2 AS BIGINT) AS preamble, 3 AS header_line FROM p""")
def S6_table_parts(spark, sf_dir):
    """S5 and S6: the header below two lines of preamble, and what stands on each side of it."""
    texts = _csv(spark, sf_dir).select("file", F.concat(F.lit("Statement of account\n\nMade for,you\n"), "text").alias("text")).withColumn("text", F.regexp_replace("text", "^Statement of account\n\n", "Statement of account\n"))
    parts = delimited.table_parts(delimited.records(texts))
    n = lambda part: F.count_if(F.col("part") == part)
    line = F.substring("ref", 2, 20).cast("int")
    body = texts.select("file", F.size(F.split("text", "\n")).alias("last_line"))
    return parts.groupBy("file").agg(n("data").alias("data"), n("preamble").alias("preamble"), F.max(F.when(F.col("part") == "header", line)).alias("header_line")).join(body, "file")


_SIGNATURES = [x for x in LAYOUTS if x.signature]


@query(f"""WITH h AS (SELECT p_partkey, list_value({", ".join("list_value(" + ", ".join(f"'{c.lower()}'" for c in x.signature) + ")" for x in _SIGNATURES)})[CAST(p_partkey % {len(_SIGNATURES)} + 1 AS INTEGER)] AS header FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'learned ' || (p_partkey % 2) WHEN p_partkey % 4 = 0 THEN NULL ELSE list_value({", ".join(f"'{x.id}'" for x in _SIGNATURES)})[CAST(p_partkey % {len(_SIGNATURES)} + 1 AS INTEGER)] END AS layout FROM h""")
def S12_layout_match(spark, sf_dir):
    """Headings of a known layout with one more column, or with one missing (a quarter of files), and a learned one first."""
    k = F.col("p_partkey")
    known = F.array(*[F.array(*[F.lit(c.lower()) for c in x.signature]) for x in _SIGNATURES])
    own = F.element_at(known, (k % len(_SIGNATURES) + 1).cast("int"))
    header = F.when(k % 13 == 0, F.array(F.lit("when"), F.lit("what"))).when(k % 4 == 0, F.slice(own, 2, 50)).otherwise(F.concat(F.array(F.lit("more")), own))
    rows = table(spark, sf_dir, "part").select("p_partkey", header.alias("header"), (k % 2).cast("string").alias("side"))
    learned = spark.range(2).select(F.lit(["when", "what"]).alias("h"), F.col("id").cast("string").alias("side")).select(delimited.header_key(F.col("h")).alias("header_key"), "side", F.concat(F.lit("learned "), "side").alias("layout_id"))
    return delimited.layout_id(rows, learned, F.size("header")).select("p_partkey", "layout")


@query("SELECT p_partkey, p_name AS by_heading, p_brand AS by_place, '' AS absent FROM part")
def P1_column_getter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_name").alias("cells"), F.array(F.lit("brand"), F.lit("the name")).alias("header"))
    get = delimited._get
    return rows.select("p_partkey", get("The Name").alias("by_heading"), get("#0").alias("by_place"), F.concat(get("Nowhere"), get("#7")).alias("absent"))


@query(with_sql(MOVEMENT) + """SELECT account_id AS file, CASE WHEN account_id % 3 = 2 AND id % 5 = 0 THEN 'skipped' ELSE 'row' END AS outcome, CASE WHEN account_id % 3 = 2 AND id % 5 = 0 THEN 'not completed (pending, declined or reverted)' END AS reason, CAST(count(*) + count(*) FILTER (account_id % 3 = 2 AND id % 4 = 0 AND id % 5 <> 0) AS BIGINT) AS n,
    CAST(sum(amount_pence) - 50 * count(*) FILTER (account_id % 3 = 2 AND id % 4 = 0 AND id % 5 <> 0) AS BIGINT) AS pence FROM movement GROUP BY 1, 2, 3""")
def P2_outcomes(spark, sf_dir):
    """P2, P3 and P4: rows by outcome and reason, their signed sums over one and two amount columns, and fee rows."""
    return delimited.parsed(_csv(spark, sf_dir)).groupBy("file", "outcome", "reason").agg(F.count("*").alias("n"), F.sum("amount_pence").alias("pence"))


@query(with_sql(MOVEMENT) + """SELECT id AS file, CASE WHEN id % 3 = 1 AND id % 10 = 0 THEN 'problem' ELSE 'row' END AS outcome, CASE WHEN id % 3 = 1 AND id % 10 = 0 THEN NULL ELSE amount_pence END AS amount_pence FROM movement""")
def P3_signs(spark, sf_dir):
    """A card's view with CR marks, two columns (both filled: a problem) and signed amounts, as one sign convention."""
    k, pence = F.col("id") % 3, F.col("amount_pence")
    size, day = pounds(F.abs(pence)), F.date_format("date", "dd/MM/yyyy")
    both = F.col("id") % 10 == 0
    card = F.array(day, F.lit("SHOP"), F.when(pence < 0, size).otherwise(F.concat(size, F.lit(" CR"))))
    two = F.array(day, F.lit("SHOP"), F.when((pence < 0) | both, size).otherwise(""), F.when((pence > 0) | both, size).otherwise(""))
    rows = movements(spark, sf_dir).select(
        F.col("id").alias("file"), F.lit(2).alias("line"), F.when(k == 0, card).when(k == 1, two).otherwise(F.array(day, F.lit("SHOP"), F.lit(""), F.lit("CARD"), pounds(pence))).alias("cells"),
        F.when(k == 0, F.lit(["date", "description", "amount"])).when(k == 1, F.lit(["transaction date", "transaction description", "debit amount", "credit amount"])).otherwise(F.lit(["date", "counter party", "reference", "type", "amount (gbp)"])).alias("header"),
        F.when(k == 0, "amex").when(k == 1, "lloyds-halifax").otherwise("starling").alias("layout"),
    )
    return delimited.mapped(rows).select("file", "outcome", F.when(F.col("outcome") == "row", F.col("amount_pence")).alias("amount_pence"))


@query(with_sql(MOVEMENT) + "SELECT id, CAST(-50 AS BIGINT) AS fee_pence, amount_pence AS next_pence FROM movement WHERE account_id % 3 = 2 AND id % 4 = 0 AND id % 5 <> 0")
def P4_fee_rows(spark, sf_dir):
    """Each fee, and the payment that follows it at once."""
    rows = movements(spark, sf_dir).where("account_id % 3 = 2")
    line = F.concat_ws(",", F.lit("CARD_PAYMENT"), F.lit("Current"), F.date_format("date", "yyyy-MM-dd 10:00:00"), F.date_format("date", "yyyy-MM-dd 10:00:00"), F.col("id").cast("string"), pounds(F.col("amount_pence")), F.when(F.col("id") % 4 == 0, "0.50").otherwise("0.00"), F.lit("GBP"), F.when(F.col("id") % 5 == 0, "PENDING").otherwise("COMPLETED"), F.lit("5.00"))
    text = F.concat(F.lit("Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance\n"), line)
    both = Window.partitionBy("file").orderBy("pos")
    read = delimited.parsed(rows.select(F.col("id").alias("file"), text.alias("text")))
    after = read.withColumn("next_pence", F.lead("amount_pence").over(both))
    return after.where("outcome = 'row' AND part = 0").select(F.col("description").cast("bigint").alias("id"), F.col("amount_pence").alias("fee_pence"), "next_pence")


@query(with_sql(MOVEMENT) + "SELECT account_id AS file, CASE account_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS header_line, CASE account_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 END AS width FROM movement GROUP BY 1")
def S5_headers(spark, sf_dir):
    """A known header below two lines, an unknown one before dated records of its width, and none."""
    k = F.col("file") % 3
    rows = movements(spark, sf_dir).groupBy(F.col("account_id").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", F.date_format("date", "dd/MM/yyyy"), "text", F.lit("1.00")))), "\n").alias("body"))
    head = F.when(k == 0, "Statement\nof,account\nDate,Counter Party,Reference,Type,Amount (GBP),Balance (GBP),Spending Category\n").when(k == 1, "Made on 1 May\nWhen,To whom,How much\n").otherwise("")
    found = delimited.headers(delimited.records(rows.select("file", F.concat(head, "body").alias("text"))))
    return found.select("file", "header_line", F.size("header").alias("width"))


@query(with_sql(MOVEMENT) + """SELECT account_id AS file, 0 AS date, CASE account_id % 2 WHEN 0 THEN '%d/%m/%Y' ELSE '%Y-%m-%d' END AS format, CASE WHEN account_id % 3 < 2 THEN 2 END AS amount, CASE WHEN account_id % 3 = 2 THEN 2 END AS "out", CASE WHEN account_id % 3 = 2 THEN 3 END AS "into",
    CASE WHEN account_id % 3 = 2 THEN 4 END AS balance, CASE WHEN account_id % 3 = 1 THEN 3 END AS direction FROM movement GROUP BY 1 HAVING max(day(date)) > 12 AND (account_id % 3 <> 2 OR (bool_or(amount_pence < 0) AND bool_or(amount_pence > 0)))""")
def P21_inferred_layout(spark, sf_dir):
    """One signed column, one with a direction, and two with a balance, in two date formats, told from the cells alone."""
    k, pence = F.col("account_id"), F.col("amount_pence")
    day = F.when(k % 2 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    size = pounds(F.abs(pence))
    cells = F.when(k % 3 == 0, F.array(day, F.col("text"), pounds(pence))).when(k % 3 == 1, F.array(day, F.col("text"), size, F.when(pence < 0, "DR").otherwise("CR"))).otherwise(F.array(day, F.col("text"), F.when(pence < 0, size).otherwise(""), F.when(pence > 0, size).otherwise(""), F.lit("10.00")))
    both = Window.partitionBy("account_id")
    told = movements(spark, sf_dir).withColumn("last", F.max(F.day("date")).over(both)).withColumn("two", F.bool_or(pence < 0).over(both) & F.bool_or(pence > 0).over(both))
    rows = told.where((F.col("last") > 12) & ((k % 3 != 2) | F.col("two"))).select(k.alias("file"), cells.alias("cells"))
    return delimited.inferred_layout(delimited.inferred_columns(rows))


@query(with_sql(MOVEMENT) + "SELECT account_id AS file, min(date) AS first_date, max(date) AS last_date FROM movement WHERE NOT (account_id % 3 = 2 AND id % 5 = 0) GROUP BY 1")
def P5_order_repair(spark, sf_dir):
    """The dates of the first and the last row of each file: newest-first files are turned round."""
    rows = delimited.parsed(_csv(spark, sf_dir)).where("outcome = 'row'")
    return rows.groupBy("file").agg(F.min_by("date", "pos").alias("first_date"), F.max_by("date", "pos").alias("last_date"))


_REVOLUT = next(x for x in LAYOUTS if x.id == "revolut")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Fee' ELSE 'Amount,State' END AS missing FROM part")
def P6_required_columns(spark, sf_dir):
    full, k = [c.lower() for c in _REVOLUT.signature], F.col("p_partkey")
    lacking = lambda *gone: F.array(*[F.lit(c) for c in full if c not in gone])
    header = F.when(k % 3 == 0, lacking()).when(k % 3 == 1, lacking("fee")).otherwise(lacking("amount", "state"))
    own = table(spark, sf_dir, "part").select("p_partkey", header.alias("header"))
    return own.select("p_partkey", F.array_join(delimited.missing_columns(F.col("header"), F.size("header"), _REVOLUT), ",").alias("missing"))


@query(with_sql(MOVEMENT) + "SELECT id, date, amount_pence, 'starling' AS layout FROM movement")
def W9_export(spark, sf_dir):
    """Transactions written as an export and read back as a bank's, quotes and commas in their texts included."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.export_csv(movements(spark, sf_dir).select("date", F.concat(F.lit('a "b", '), F.col("id").cast("string")).alias("description"), "amount_pence"), path)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    back = delimited.parsed(files).where("outcome = 'row'")
    return back.select(F.regexp_extract("description", r"(\d+)$", 1).cast("bigint").alias("id"), "date", "amount_pence", "layout")


# Series, step by step


@query("""SELECT c_custkey, d AS gap, CASE WHEN round_even(d / 30.44, 0) BETWEEN 1 AND 3 AND abs(d - round_even(d / 30.44, 0) * 30.44) <= 4.5 * round_even(d / 30.44, 0) THEN CAST(round_even(d / 30.44, 0) AS INTEGER) END AS monthly,
    CASE WHEN round_even(d / 7.0, 0) BETWEEN 1 AND 3 AND abs(d - round_even(d / 7.0, 0) * 7) <= 1.5 * round_even(d / 7.0, 0) THEN CAST(round_even(d / 7.0, 0) AS INTEGER) END AS weekly FROM (SELECT c_custkey, CAST(c_custkey % 130 AS INTEGER) AS d FROM customer)""")
def WN2_gap_steps(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130).cast("int").alias("gap"))
    return own.select("c_custkey", "gap", series.gap_steps(F.col("gap"), "monthly").alias("monthly"), series.gap_steps(F.col("gap"), "weekly").alias("weekly"))


@query("""WITH d AS (SELECT c_custkey, unnest(range(0, 5)) AS k FROM customer), e AS (SELECT c_custkey, k, CAST(DATE '2023-01-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS m, c_custkey % 3 AS kind, c_custkey % 20 AS o FROM d),
    f AS (SELECT c_custkey, CASE kind WHEN 0 THEN last_day(m) - CAST((c_custkey + k) % 4 AS INTEGER) WHEN 1 THEN m + CAST(5 + o % 15 + (k * 7 + c_custkey) % 6 AS INTEGER) ELSE m + CAST((k * 11 + c_custkey) % 27 AS INTEGER) END AS date FROM e),
    g AS (SELECT c_custkey, list_sort(list(day(date))) AS days, bool_and(day(last_day(date)) - day(date) <= 4) AS at_end FROM f GROUP BY 1), h AS (SELECT *, days[len(days) // 2 + 1] AS middle FROM g)
    SELECT c_custkey, CASE WHEN len(list_distinct(days)) > 1 AND at_end THEN 0 WHEN days[1] >= middle - 4 AND days[-1] <= middle + 4 THEN CAST(middle AS INTEGER) END AS usual_day FROM h""")
def WN4_usual_day(spark, sf_dir):
    k, c = F.col("k"), F.col("c_custkey")
    dated = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).withColumn("m", F.add_months(F.lit("2023-01-01").cast("date"), k))
    end = F.date_sub(F.last_day("m"), ((c + k) % 4).cast("int"))
    date = F.when(c % 3 == 0, end).when(c % 3 == 1, F.date_add("m", (5 + c % 20 % 15 + (k * 7 + c) % 6).cast("int"))).otherwise(F.date_add("m", ((k * 11 + c) % 27).cast("int")))
    return dated.groupBy("c_custkey").agg(F.array_sort(F.collect_list(date)).alias("dates")).select("c_custkey", series.usual_day(F.col("dates")).alias("usual_day"))


_PAID = "p AS (SELECT account_id, id, date, -amount_pence AS pence, row_number() OVER (PARTITION BY account_id ORDER BY {0}) AS i FROM ledger WHERE amount_pence < 0)"


def _paid(spark, sf_dir):
    return ledger(spark, sf_dir).where("amount_pence < 0").select("account_id", "id", "date", (-F.col("amount_pence")).alias("pence"))


@query(with_sql(LEDGER, _PAID.format("date, id")).replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT account_id, i, pence AS anchor, 1 AS level, date AS since FROM p WHERE i = 1
        UNION ALL SELECT p.account_id, p.i, CASE WHEN j THEN r.anchor ELSE p.pence END, r.level + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN j THEN r.since ELSE p.date END FROM r JOIN p ON p.account_id = r.account_id AND p.i = r.i + 1, LATERAL (SELECT abs(p.pence - r.anchor) <= greatest(50, CAST(round_even(r.anchor * 0.03, 0) AS BIGINT)) AS j))
    , l AS (SELECT account_id, level, min(since) AS since, count(*) AS n, max(i) AS last FROM r GROUP BY 1, 2), m AS (SELECT *, max(level) OVER (PARTITION BY account_id) AS levels FROM l)
    SELECT m.account_id, CAST(m.levels AS INTEGER) AS levels, m.since AS last_since, p.pence AS last_pence, m.levels > 4 OR (SELECT count(*) FROM m o WHERE o.account_id = m.account_id AND o.level < o.levels AND o.n = 1) > 1 AS varies FROM m JOIN p ON p.account_id = m.account_id AND p.i = m.last WHERE m.level = m.levels""")
def WN5_price_levels(spark, sf_dir):
    one = F.transform(F.array_sort(F.collect_list(F.struct("date", "id", "pence"))), lambda p: F.struct(p["date"].alias("date"), p["pence"].alias("pence"), F.lit(1).alias("n")))
    own = _paid(spark, sf_dir).groupBy("account_id").agg(one.alias("changes")).withColumn("levels", series.price_levels(F.col("changes")))
    last = F.element_at("levels", -1)
    return own.select("account_id", F.size("levels").alias("levels"), last["since"].alias("last_since"), last["amount_pence"].alias("last_pence"), series.varying(F.col("levels")).alias("varies"))


@query(with_sql(LEDGER, _PAID.format("-amount_pence, id")).replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT account_id, i, id, pence AS wide, pence AS tight FROM p WHERE i = 1
        UNION ALL SELECT p.account_id, p.i, p.id, CASE WHEN p.pence <= r.wide * 1.15 THEN r.wide ELSE p.pence END, CASE WHEN p.pence - r.tight <= greatest(10, CAST(round_even(r.tight * 0.01, 0) AS BIGINT)) THEN r.tight ELSE p.pence END FROM r JOIN p ON p.account_id = r.account_id AND p.i = r.i + 1),
    s AS (SELECT account_id, max(pence) > 1.6 * min(pence) AS spread FROM p GROUP BY 1), n AS (SELECT *, count(*) OVER (PARTITION BY account_id, tight) AS same FROM r)
    SELECT n.id, CASE WHEN spread THEN wide ELSE -1 END AS cluster, CASE WHEN same > 1 THEN tight END AS equal FROM n JOIN s USING (account_id)""")
def WN6_clusters(spark, sf_dir):
    """WN6 and WN7: the cluster of each payment among its account's, and the group of equal amounts, where it has one."""
    own = series.with_cluster(_paid(spark, sf_dir), ["account_id"], 0.15)
    equal = series.with_equal(_paid(spark, sf_dir), ["account_id"]).select("id", "equal")
    return own.select("id", "cluster").join(equal, "id", "left")


def household(spark, sf_dir):
    """Two years of monthly payments for each customer, by customer's number: steady, never in February and March, stopped
    after a year, dearer after a year, with a trial before, or missing twice."""
    c, k = F.col("c_custkey"), F.col("k")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    customers = dealt_by_rows(customers, customers.count(), 20_000, "c_custkey")  # of few bytes, but of some 24 payments each
    months = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("k"))
    day = F.date_add(F.add_months(F.lit("2023-01-01").cast("date"), k), (c % 28).cast("int"))
    kept = F.when(c % 6 == 1, ~F.month(day).isin(2, 3)).when(c % 6 == 2, k < 12).when(c % 6 == 5, ~k.isin(6, 7)).otherwise(True)
    pence = 1_000 + c % 50 + F.when((c % 6 == 3) & (k >= 12), 400).otherwise(0)
    paid = months.where(kept).select((c % 97).alias("merchant_id"), c.alias("account_id"), (c * 100 + k).alias("id"), day.alias("date"), pence.alias("pence"))
    trial = customers.where(c % 6 == 4).select((c % 97).alias("merchant_id"), c.alias("account_id"), (c * 100 + 50).alias("id"), F.date_sub(F.date_add(F.lit("2023-01-01").cast("date"), (c % 28).cast("int")), 10).alias("date"), F.lit(100).cast("bigint").alias("pence"))
    return paid.unionByName(trial)


_HOUSE = "h AS (SELECT c_custkey AS c, c_custkey % 6 AS kind, 1000 + c_custkey % 50 AS price, CAST(c_custkey % 28 AS INTEGER) AS o FROM customer)"


@query(with_sql(_HOUSE) + """SELECT c AS account_id, c % 97 AS merchant_id, 'monthly' AS cadence, price + CASE kind WHEN 3 THEN 400 ELSE 0 END AS expected_pence, o + 1 AS expected_day, CASE kind WHEN 1 THEN '2,3' ELSE '' END AS skip_months,
        CASE kind WHEN 5 THEN strftime(DATE '2023-07-01' + o, '%Y-%m-%d') || ',' || strftime(DATE '2023-08-01' + o, '%Y-%m-%d') ELSE '' END AS missed, CASE kind WHEN 2 THEN 'lapsed' ELSE 'active' END AS status,
        CASE kind WHEN 2 THEN DATE '2024-01-01' + o ELSE DATE '2025-01-01' + o END AS next_due, CASE kind WHEN 1 THEN 10 ELSE 12 END * (price + CASE kind WHEN 3 THEN 400 ELSE 0 END) AS annual_pence,
        CASE kind WHEN 1 THEN 20 WHEN 2 THEN 12 WHEN 5 THEN 22 ELSE 24 END AS occurrences, CASE kind WHEN 4 THEN c * 100 + 50 END AS trial_id, CASE kind WHEN 3 THEN 2 ELSE 1 END AS prices FROM h""")
def WN10_household_series(spark, sf_dir):
    """WN8, WN9, WN10, WN11 and WN19: all that is told of a series, over two years of each customer's payments."""
    found = series.detect(household(spark, sf_dir), datetime.date(2024, 12, 31))
    shown = F.array_join(F.transform("missed", lambda d: F.date_format(d, "yyyy-MM-dd")), ",")
    return found.select("account_id", "merchant_id", "cadence", "expected_pence", "expected_day", F.array_join(F.transform("skip_months", lambda m: m.cast("string")), ",").alias("skip_months"), shown.alias("missed"), "status", "next_due", "annual_pence", "occurrences", "trial_id", F.size("price_history").alias("prices"))


@query(with_sql(_HOUSE) + "SELECT c AS account_id, CASE WHEN kind = 2 AND c % 4 = 0 THEN 'lapsed' ELSE 'active' END AS status FROM h")
def ST6_lapse_by_coverage(spark, sf_dir):
    """A series lapses by how far an account's data goes: here to the end of 2024 for every fourth account, else to its last payment."""
    paid = household(spark, sf_dir)
    last = paid.groupBy("account_id").agg(F.max("date").alias("last"))
    until = last.select("account_id", F.when(F.col("account_id") % 4 == 0, F.lit("2024-12-31").cast("date")).otherwise(F.col("last")).alias("until"))
    return series.detect(paid, until).select("account_id", "status")


@query(with_sql(_HOUSE) + """, t AS (SELECT c % 97 AS m, count(*) FILTER (kind <> 2) AS live FROM h GROUP BY 1)
    SELECT c AS account_id, concat_ws(',', CASE WHEN kind = 3 THEN 'price rise' END, CASE WHEN kind = 4 THEN 'trial' END, CASE WHEN kind = 2 THEN 'lapsed' END, CASE WHEN kind <> 2 AND live > 1 THEN 'duplicate' END) AS flags FROM h JOIN t ON t.m = c % 97""")
def D8_commitment_flags(spark, sf_dir):
    """WN18 and D8: the flags of the same series."""
    return composites.commitment_run(household(spark, sf_dir), datetime.date(2024, 12, 31)).select("account_id", F.array_join("flags", ",").alias("flags"))


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), d AS (SELECT month, CAST(unnest(generate_series(CAST(date_trunc('week', month) AS DATE), CAST(date_trunc('week', last_day(month)) AS DATE) + 6, INTERVAL 1 DAY)) AS DATE) AS day FROM m)
    SELECT month, CAST(date_trunc('week', day) AS DATE) AS week, CAST(isodow(day) - 1 AS INTEGER) AS weekday, day, month(day) = month(month) AS inside FROM d""")
def F37_month_weeks(spark, sf_dir):
    return month_grid(table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).distinct())


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) + 20 AS INTEGER) AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
    h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l),
    e AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday FROM m),
    d AS (SELECT y, sunday, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
    n AS (SELECT *, isodow(day) = 1 AS monday, month(day) AS mo, day(day) AS dd FROM d),
    r AS (SELECT unnest(['england', 'northern-ireland']) AS division, day FROM n WHERE day IN (sunday - 2, sunday + 1) OR (monday AND ((mo = 5 AND (dd <= 7 OR dd > 24)) OR (mo = 8 AND dd > 24)))
        UNION ALL SELECT 'scotland', day FROM n WHERE day = sunday - 2 OR (monday AND ((mo = 5 AND (dd <= 7 OR dd > 24)) OR (mo = 8 AND dd <= 7)))
        UNION ALL SELECT v, min(day) FROM n, (VALUES ('england'), ('scotland'), ('northern-ireland')) t(v) WHERE mo = 1 AND isodow(day) < 6 GROUP BY y, v
        UNION ALL SELECT v, min(day) FROM n, (VALUES ('england'), ('scotland'), ('northern-ireland')) t(v) WHERE mo = 12 AND dd >= 25 AND isodow(day) < 6 GROUP BY y, v
        UNION ALL SELECT 'scotland', (list_sort(list(day)))[2] FROM n WHERE mo = 1 AND isodow(day) < 6 GROUP BY y
        UNION ALL SELECT v, (list_sort(list(day)))[2] FROM n, (VALUES ('england'), ('scotland'), ('northern-ireland')) t(v) WHERE mo = 12 AND dd >= 25 AND isodow(day) < 6 GROUP BY y, v
        UNION ALL SELECT 'scotland', min(day) FROM n WHERE (mo = 11 AND dd = 30 OR mo = 12 AND dd < 4) AND isodow(day) < 6 GROUP BY y
        UNION ALL SELECT 'northern-ireland', min(day) FROM n WHERE mo = 3 AND dd BETWEEN 17 AND 20 AND isodow(day) < 6 GROUP BY y
        UNION ALL SELECT 'northern-ireland', min(day) FROM n WHERE mo = 7 AND dd BETWEEN 12 AND 15 AND isodow(day) < 6 GROUP BY y)
    SELECT division, day FROM r""")
def S21_bank_holidays(spark, sf_dir):
    """The regular bank holidays of the years of orders (twenty years on), against another form of the Easter rule."""
    years = table(spark, sf_dir, "orders").select((F.year("o_orderdate") + 20).alias("year")).distinct()
    return bank_holidays(years).select("division", "day")
