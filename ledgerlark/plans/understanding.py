"""Rules, memory, decisions, matching and set operators over the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.text import description_tokens, merchant_key, normal_description, similar_tokens, variant
from ..operators import matching, rules, understanding
from .adapter import CATEGORY, LEDGER, MOVEMENT, categories, ledger, movements, table, with_sql
from .registry import query

_DAY = datetime.date
#: rule_id, merchant, phrase, least and most pence, account, direction, from, to, who, category, source, created
RULES = [
    ("r1", 5, None, None, None, None, None, None, None, None, "asia.nation-2.furniture", "person", 3),
    ("r2", None, "URGENT", None, None, None, "out", None, None, None, "europe.nation-3.building", "person", 1),
    ("r3", None, None, 10_000_000, 20_000_000, None, None, None, None, None, "africa.nation-0.household", "seed", 0),
    ("r4", None, None, None, None, 77, None, _DAY(1996, 1, 1), _DAY(1999, 12, 31), None, "america.nation-1.machinery", "person", 2),
    ("r5", None, "LOW", None, 8_000_000, None, "in", None, None, "household", "asia.nation-7.building", "seed", 0),
    ("r6", 5, None, None, None, None, "in", None, None, None, "asia.nation-12.building", "person", 4),
]


def rule_table(spark):
    return spark.createDataFrame(RULES, rules.SCHEMA)


def _literal(v) -> str:
    return "NULL" if v is None else f"DATE '{v}'" if isinstance(v, _DAY) else repr(v)


_RULE = "rule(rule_id, merchant_id, phrase, min_pence, max_pence, account_id, direction, date_from, date_to, who, set_category_id, source, created) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in RULES) + ")"
_MATCH = """(r.merchant_id IS NULL OR r.merchant_id = t.merchant_id) AND (r.account_id IS NULL OR r.account_id = t.account_id) AND (r.who IS NULL OR r.who = t.who)
    AND (r.min_pence IS NULL OR abs(t.amount_pence) >= r.min_pence) AND (r.max_pence IS NULL OR abs(t.amount_pence) <= r.max_pence) AND (r.direction IS NULL OR (r.direction = 'in') = (t.amount_pence > 0))
    AND (r.date_from IS NULL OR t.date >= r.date_from) AND (r.date_to IS NULL OR t.date <= r.date_to)
    AND (r.phrase IS NULL OR contains(' ' || array_to_string(regexp_extract_all(upper(t.text), '[A-Z0-9]+'), ' ') || ' ', ' ' || r.phrase || ' '))"""
_WEIGHT = """CASE WHEN r.merchant_id IS NULL THEN 0 ELSE 4 END + CASE WHEN phrase IS NULL THEN 0 ELSE 3 END + CASE WHEN r.account_id IS NULL THEN 0 ELSE 2 END + CASE WHEN min_pence IS NULL AND max_pence IS NULL THEN 0 ELSE 2 END
    + CASE WHEN r.who IS NULL THEN 0 ELSE 1 END + CASE WHEN direction IS NULL THEN 0 ELSE 1 END + CASE WHEN date_from IS NULL AND date_to IS NULL THEN 0 ELSE 1 END"""
_BEST = f"""best AS (SELECT id, rule_id, set_category_id FROM (SELECT t.id, r.rule_id, set_category_id, row_number() OVER (PARTITION BY t.id ORDER BY {_WEIGHT} DESC, (source <> 'seed') DESC, created DESC, rule_id DESC) AS n
    FROM ledger t JOIN rule r ON {_MATCH}) WHERE n = 1)"""


@query(with_sql(LEDGER, _RULE, _BEST) + "SELECT * FROM best")
def J8_best_rule(spark, sf_dir):
    return rules.best_rules(ledger(spark, sf_dir), rule_table(spark))


@query(with_sql(_RULE) + f"SELECT rule_id, CAST({_WEIGHT} AS INTEGER) AS weight, count(o_orderkey) AS seen FROM rule r LEFT JOIN orders ON o_custkey = r.account_id GROUP BY ALL")
def F30_specificity(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.count("*").alias("seen"))
    return rule_table(spark).join(own, "account_id", "left").select("rule_id", rules.specificity().alias("weight"), F.coalesce("seen", F.lit(0)).alias("seen"))


@query(with_sql(LEDGER, _RULE) + f"SELECT rule_id, count(*) AS matches, count(*) FILTER (status <> 'confirmed' AND category_id IS DISTINCT FROM set_category_id) AS will_change, count(*) FILTER (status = 'confirmed') AS kept FROM ledger t JOIN rule r ON {_MATCH} GROUP BY rule_id")
def A23_rule_preview(spark, sf_dir):
    met = ledger(spark, sf_dir).alias("t").join(F.broadcast(rule_table(spark)).alias("r"), rules.matches("r", "t"))
    changes = (F.col("status") != "confirmed") & ~F.col("category_id").eqNullSafe(F.col("set_category_id"))
    return met.groupBy("rule_id").agg(F.count("*").alias("matches"), F.count_if(changes).alias("will_change"), F.count_if(F.col("status") == "confirmed").alias("kept"))


_DECISIONS = "d AS (SELECT merchant_id, split_part(category_id, '.', 1) AS category_id, CASE WHEN who <> 'household' THEN who END AS who, confidence, abs(amount_pence) AS pence FROM ledger WHERE category_id IS NOT NULL)"


@query(with_sql(LEDGER, _DECISIONS) + """, c AS (SELECT merchant_id, category_id, count(*) AS n, sum(pence) AS pence, sum(confidence) AS confidence FROM d GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, pence DESC, category_id) AS k, sum(n) OVER (PARTITION BY merchant_id) AS total FROM c),
    w AS (SELECT merchant_id, category_id, who FROM (SELECT merchant_id, category_id, who, row_number() OVER (PARTITION BY merchant_id, category_id ORDER BY count(*) DESC, who) AS k FROM d WHERE who IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1)
    SELECT merchant_id, b.category_id, n AS rows, CAST(round(n / total, 3) AS DOUBLE) AS share, CAST(round_even(n / total * (confidence / n), 3) AS DOUBLE) AS confidence, who FROM b LEFT JOIN w USING (merchant_id, category_id) WHERE k = 1 AND total >= 3 AND n / total >= 0.25""")
def A5_merchant_memory(spark, sf_dir):
    d = ledger(spark, sf_dir).where("category_id IS NOT NULL").select("merchant_id", F.substring_index("category_id", ".", 1).alias("category_id"), F.when(F.col("who") != "household", F.col("who")).alias("who"), "confidence", F.abs("amount_pence").alias("pence"))
    return understanding.infer_memory(d, 3, 0.25)


_VERSIONS = "v AS (SELECT CAST(event_id % 13 AS INTEGER) AS version, CASE WHEN event_id % 2 = 0 THEN user_id % 97 END AS merchant_id, CASE WHEN event_id % 2 = 1 THEN 'asia.nation-' || (event_id % 25) || '.building' END AS category_id FROM events WHERE event_type = 'error')"


def versions(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("event_id") % 13).cast("int").alias("version"), F.expr("CASE WHEN event_id % 2 = 0 THEN user_id % 97 END").alias("merchant_id"), F.expr("CASE WHEN event_id % 2 = 1 THEN concat('asia.nation-', event_id % 25, '.building') END").alias("category_id"))


@query(with_sql(LEDGER, _VERSIONS) + "SELECT id, knowledge_version FROM ledger l WHERE EXISTS (SELECT 1 FROM v WHERE v.version > l.knowledge_version AND (v.merchant_id = l.merchant_id OR v.category_id = l.category_id))")
def P11_stale_rows(spark, sf_dir):
    return understanding.stale(ledger(spark, sf_dir), versions(spark, sf_dir)).select("id", "knowledge_version")


@query(with_sql(LEDGER) + """SELECT id, CASE WHEN category_id IS NULL THEN 'no category' WHEN status = 'unknown' THEN 'unknown' WHEN confidence < 0.7 THEN 'unsure' ELSE 'other' END AS reason FROM ledger
    WHERE status <> 'confirmed' AND (category_id IS NULL OR status = 'unknown' OR confidence < 0.7) ORDER BY CASE WHEN category_id IS NULL OR status = 'unknown' THEN 0 ELSE 1 END, abs(amount_pence) DESC, date DESC, id LIMIT 200""")
def D7_backlog_sweep(spark, sf_dir):
    first = F.col("category_id").isNull() | (F.col("status") == "unknown")
    reason = F.when(F.col("category_id").isNull(), "no category").when(F.col("status") == "unknown", "unknown").when(F.col("confidence") < 0.7, "unsure").otherwise("other")
    rows = ledger(spark, sf_dir).where((F.col("status") != "confirmed") & (first | (F.col("confidence") < 0.7)))
    return rows.orderBy(F.when(first, 0).otherwise(1), F.desc(F.abs("amount_pence")), F.desc("date"), "id").limit(200).select("id", reason.alias("reason"))


_NEW = "CASE WHEN o_orderkey % 2 = 0 THEN 'model' WHEN o_orderkey % 31 = 0 THEN 'human' ELSE 'rule' END"
_DECIDED = f"dec AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN 'africa.nation-0.building' END AS category_id, CAST(NULL AS VARCHAR) AS who, CAST((o_orderkey % 50) / 50.0 AS DOUBLE) AS confidence, {_NEW} AS decided_by, CASE {_NEW} WHEN 'model' THEN 40 WHEN 'human' THEN 100 ELSE 80 END AS authority FROM orders WHERE o_orderstatus <> 'P')"


def decisions(spark, sf_dir):
    by = F.expr(_NEW)
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 9 <> 0 THEN 'africa.nation-0.building' END").alias("category_id"), F.lit(None).cast("string").alias("who"), F.expr("cast((o_orderkey % 50) / 50.0 AS double)").alias("confidence"), by.alias("decided_by"), F.when(by == "model", 40).when(by == "human", 100).otherwise(80).alias("authority"))


_MERGED = f"""merged AS (SELECT l.id, CASE WHEN ok THEN coalesce(d.category_id, l.category_id) ELSE l.category_id END AS category_id, CASE WHEN ok THEN coalesce(d.who, l.who) ELSE l.who END AS who,
    CASE WHEN ok THEN d.confidence ELSE l.confidence END AS confidence, CASE WHEN ok THEN d.decided_by ELSE l.decided_by END AS decided_by, CASE WHEN ok THEN d.authority ELSE l.authority END AS authority,
    CASE WHEN NOT ok THEN status WHEN d.decided_by = 'human' THEN 'confirmed' WHEN d.confidence >= 0.8 THEN 'inferred' ELSE 'low_confidence' END AS status
    FROM (SELECT l.*, coalesce(d.decided_by = 'human' OR (l.status <> 'confirmed' AND d.authority >= l.authority), false) AS ok FROM ledger l LEFT JOIN dec d USING (id)) l LEFT JOIN dec d USING (id))"""
_MERGED_COLUMNS = ["id", "category_id", "who", "confidence", "decided_by", "authority", "status"]


@query(with_sql(LEDGER, _DECIDED, _MERGED) + "SELECT * FROM merged")
def P13_decision_merge(spark, sf_dir):
    return understanding.merged(ledger(spark, sf_dir).select(*_MERGED_COLUMNS), decisions(spark, sf_dir))


@query(with_sql(LEDGER, _DECIDED, _MERGED) + "SELECT m.* FROM merged m JOIN ledger l USING (id) WHERE m.category_id IS DISTINCT FROM l.category_id OR m.status IS DISTINCT FROM l.status OR round(m.confidence, 3) IS DISTINCT FROM round(l.confidence, 3)")
def W6_history(spark, sf_dir):
    before = ledger(spark, sf_dir).select(*_MERGED_COLUMNS)
    return understanding.history(before, understanding.merged(before, decisions(spark, sf_dir)), ["category_id", "status", "confidence"])


@query(with_sql(LEDGER, CATEGORY) + """, a AS (SELECT event_id % 15000 AS id, event_id AS pos, CASE event_id % 4 WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' WHEN 2 THEN 'nowhere' ELSE 'africa' END AS category_id, 'p' || (event_id % 4) AS who, value / 100 - 0.5 AS confidence FROM events)
    SELECT id, category_id, CASE WHEN who IN ('p0', 'p1') THEN who ELSE 'household' END AS who, greatest(0.0, least(1.0, confidence)) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM a) a JOIN (SELECT id, amount_pence FROM ledger) l USING (id) JOIN (SELECT id AS category_id, kind FROM category) c USING (category_id) WHERE n = 1 AND (kind <> 'income' OR amount_pence >= 0)""")
def P14_valid_answers(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select((F.col("event_id") % 15000).alias("id"), F.col("event_id").alias("pos"), F.expr("CASE event_id % 4 WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' WHEN 2 THEN 'nowhere' ELSE 'africa' END").alias("category_id"), F.expr("concat('p', event_id % 4)").alias("who"), F.expr("value / 100 - 0.5").alias("confidence"))
    return understanding.valid_answers(answers, ledger(spark, sf_dir), categories(spark, sf_dir), ["p0", "p1"])


_WORDS = "len(list_filter(['" + "', '".join(matching.TRANSFER_WORDS) + "'], lambda w: regexp_matches({0}, '\\b' || w || '\\b') OR regexp_matches({1}, '\\b' || w || '\\b')))"


@query(with_sql(MOVEMENT) + f"""SELECT abs(o.amount_pence) AS size, o.id AS out_id, i.id AS in_id, o.date AS out_date, CAST(abs(date_diff('day', o.date, i.date)) AS INTEGER) AS gap, CAST({_WORDS.format('o.text', 'i.text')} AS INTEGER) AS words,
    i.account_kind = 'credit_card' AND o.account_kind <> 'credit_card' AS card, (contains(o.text, 'REFUND') OR contains(i.text, 'REFUND')) AS against
    FROM movement o JOIN movement i ON o.amount_pence < 0 AND i.amount_pence = -o.amount_pence AND o.account_id <> i.account_id AND abs(date_diff('day', o.date, i.date)) <= 3""")
def J6_pair_candidates(spark, sf_dir):
    return matching.pair_candidates(movements(spark, sf_dir))


#: Edges of one size in their order, walked one by one: an edge is taken if neither end has been.
PAIRED = f"""edge AS (SELECT abs(o.amount_pence) AS size, o.id AS out_id, i.id AS in_id, o.date AS out_date, CAST(abs(date_diff('day', o.date, i.date)) AS INTEGER) AS gap, CAST({_WORDS.format('o.text', 'i.text')} AS INTEGER) AS words,
        i.account_kind = 'credit_card' AND o.account_kind <> 'credit_card' AS card, (contains(o.text, 'REFUND') OR contains(i.text, 'REFUND')) AS against
        FROM free o JOIN free i ON o.amount_pence < 0 AND i.amount_pence = -o.amount_pence AND o.account_id <> i.account_id AND abs(date_diff('day', o.date, i.date)) <= 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY gap, words DESC, out_date, out_id, in_id) AS r FROM edge),
    walk AS (SELECT size, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, false AS taken FROM (SELECT DISTINCT size FROM edge)
        UNION ALL SELECT w.size, e.r, CASE WHEN list_contains(w.used, e.out_id) OR list_contains(w.used, -e.in_id - 1) THEN w.used ELSE list_concat(w.used, [e.out_id, -e.in_id - 1]) END,
            NOT (list_contains(w.used, e.out_id) OR list_contains(w.used, -e.in_id - 1)) FROM walk w JOIN ranked e ON e.size = w.size AND e.r = w.r + 1),
    pair AS (SELECT e.*, CASE WHEN against THEN 0.6 WHEN words > 0 THEN 0.99 WHEN card OR gap = 0 THEN 0.75 ELSE 0.7 END AS confidence FROM ranked e JOIN walk USING (size, r) WHERE taken)"""


@query(with_sql(MOVEMENT, "free AS (SELECT * FROM movement)", PAIRED).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT out_id, in_id, gap, words, card, CAST(confidence AS DOUBLE) AS confidence FROM pair")
def J6_transfer_pairs(spark, sf_dir):
    return matching.pair_transfers(movements(spark, sf_dir))


_LINES = """line AS (SELECT event_id AS id, user_id AS account_id, event_id % 5 AS statement_id, CAST(ts AS DATE) AS date, CAST(round(value) AS BIGINT) * 100 AS amount_pence, event_type || '  Ref' || (event_id % 3) AS raw_description, event_id AS pos FROM events)"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), (F.col("event_id") % 5).alias("statement_id"), F.col("ts").cast("date").alias("date"), (F.round("value").cast("bigint") * 100).alias("amount_pence"), F.expr("concat(event_type, '  Ref', event_id % 3)").alias("raw_description"), F.col("event_id").alias("pos"))


_PRINTED = """printed AS (SELECT *, substr(sha256(concat_ws('|', account_id, strftime(date, '%Y-%m-%d'), CASE WHEN amount_pence < 0 THEN '-' ELSE '' END || (abs(amount_pence) // 100) || '.' || lpad(CAST(abs(amount_pence) % 100 AS VARCHAR), 2, '0'), lower(trim(regexp_replace(raw_description, '\\s+', ' ', 'g'))), occurrence)), 1, 24) AS fingerprint
    FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, account_id, date, amount_pence, lower(trim(regexp_replace(raw_description, '\\s+', ' ', 'g'))) ORDER BY pos) - 1 AS occurrence FROM line))"""


@query(with_sql(_LINES, _PRINTED) + "SELECT id, occurrence, fingerprint FROM printed")
def A7_fingerprints(spark, sf_dir):
    return matching.fingerprinted(lines(spark, sf_dir)).select("id", F.col("occurrence").cast("bigint").alias("occurrence"), "fingerprint")


@query(with_sql(_LINES, _PRINTED) + "SELECT id FROM printed p WHERE statement_id = 0 AND EXISTS (SELECT 1 FROM printed q WHERE q.statement_id <> 0 AND q.fingerprint = p.fingerprint AND q.account_id = p.account_id)")
def J4_exact_dedupe(spark, sf_dir):
    own = matching.fingerprinted(lines(spark, sf_dir))
    stored = own.where("statement_id <> 0").select("account_id", "fingerprint").distinct()
    return own.where("statement_id = 0").join(stored, ["account_id", "fingerprint"], "left_semi").select("id")


#: New rows of one amount in their order, twice, each taking its first similar free candidate of the first 32.
DEDUPED = """pool AS (SELECT p.*, string_split(lower(raw_description), '  ') AS w FROM printed p),
    newer AS (SELECT * FROM pool WHERE {new}), older AS (SELECT * FROM pool WHERE {stored}),
    exact AS (SELECT n.id FROM newer n WHERE EXISTS (SELECT 1 FROM older o WHERE o.account_id = n.account_id AND o.fingerprint = n.fingerprint)),
    candidate AS (SELECT n.account_id, n.amount_pence, n.id, n.pos, list({{'id': o.id, 'gap': abs(date_diff('day', n.date, o.date)), 'alike': n.w = o.w}} ORDER BY abs(date_diff('day', n.date, o.date)), o.pos, o.id) AS near
        FROM newer n JOIN older o ON o.account_id = n.account_id AND o.amount_pence = n.amount_pence AND abs(date_diff('day', n.date, o.date)) <= 2
        WHERE n.id NOT IN (SELECT id FROM exact) AND NOT EXISTS (SELECT 1 FROM newer x WHERE x.account_id = o.account_id AND x.fingerprint = o.fingerprint) GROUP BY ALL),
    turn AS (SELECT *, row_number() OVER (PARTITION BY account_id, amount_pence ORDER BY pass, pos, id) AS r FROM candidate, (VALUES (0), (2)) v(pass)),
    walk AS (SELECT account_id, amount_pence, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS matched FROM (SELECT DISTINCT account_id, amount_pence FROM turn)
        UNION ALL SELECT account_id, amount_pence, r, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, CASE WHEN pick IS NULL THEN matched ELSE list_append(matched, id) END
        FROM (SELECT t.account_id, t.amount_pence, t.r, w.taken, w.matched, t.id, CASE WHEN NOT list_contains(w.matched, t.id) THEN
            list_filter(list_filter(t.near, lambda c: c.gap <= t.pass AND NOT list_contains(w.taken, c.id))[1:32], lambda c: c.alike)[1].id END AS pick
            FROM walk w JOIN turn t ON t.account_id = w.account_id AND t.amount_pence = w.amount_pence AND t.r = w.r + 1)),
    plan AS (SELECT n.id, n.statement_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'similar' ELSE 'new' END AS match
        FROM newer n LEFT JOIN exact e USING (id) LEFT JOIN (SELECT DISTINCT unnest(matched) AS id FROM walk) m USING (id))"""


@query(with_sql(_LINES, _PRINTED, DEDUPED.format(new="statement_id = 0", stored="statement_id <> 0")).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT id, match FROM plan")
def J5_dedupe_plan(spark, sf_dir):
    own = matching.fingerprinted(lines(spark, sf_dir))
    return matching.dedupe_plan(own.where("statement_id = 0"), own.where("statement_id <> 0"))


@query(with_sql(_LINES) + "SELECT date, amount_pence, k FROM (SELECT date, amount_pence, row_number() OVER (PARTITION BY date, amount_pence ORDER BY id) AS k FROM line WHERE statement_id = 0) JOIN (SELECT date, amount_pence, row_number() OVER (PARTITION BY date, amount_pence ORDER BY id) AS k FROM line WHERE statement_id = 1) USING (date, amount_pence, k)")
def A20_multiset_match(spark, sf_dir):
    own = lines(spark, sf_dir)
    return matching.multiset_matches(own.where("statement_id = 0"), own.where("statement_id = 1"), ["date", "amount_pence"]).withColumn("k", F.col("k").cast("bigint"))


@query(with_sql(MOVEMENT) + """, p AS (SELECT id, account_id, id - id % 7 + 1 AS pair_id FROM movement) SELECT a.id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.id = a.pair_id AND b.pair_id = a.pair_id)""")
def J9_orphan_halves(spark, sf_dir):
    p = movements(spark, sf_dir).select("id", (F.col("id") - F.col("id") % 7 + 1).alias("pair_id"))
    back = p.select(F.col("id").alias("pair_id"), F.col("pair_id").alias("back")).where("back = pair_id").select("pair_id")
    return p.join(back, "pair_id", "left_anti").select("id")


@query("""WITH n AS (SELECT s_suppkey, p_name || ' LTD ' || (1000 + s_suppkey * 137) || ' LONDON GB' AS text FROM supplier JOIN part ON p_partkey = s_suppkey)
    SELECT s_suppkey, p_name AS merchant_key FROM n JOIN part ON p_partkey = s_suppkey""")
def F10_merchant_key(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    return named.select("s_suppkey", merchant_key(F.expr("concat(p_name, ' LTD ', 1000 + s_suppkey * 137, ' LONDON GB')")).alias("merchant_key"))


@query("""WITH v AS (SELECT DISTINCT substr(regexp_replace(upper(trim(regexp_replace(p_brand || '  ' || p_name || p_size, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g'), 1, 120) AS variant, lower(p_name) AS key FROM part)
    SELECT variant, key, substr(sha256(key), 1, 16) AS merchant_id FROM v""")
def D1_merchant_resolve(spark, sf_dir):
    printed = table(spark, sf_dir, "part").select(variant(F.expr("concat(p_brand, '  ', p_name, p_size)"), F.lit(None).cast("string")).alias("variant"), merchant_key(F.col("p_name")).alias("key")).distinct()
    return printed.select("variant", "key", F.substring(F.sha2("key", 256), 1, 16).alias("merchant_id"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$'))) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b FROM t a JOIN t b ON b.item_id = a.item_id + 1 WHERE len(a.w) > 0 AND len(b.w) > 0 AND (len(list_intersect(a.w, b.w)) IN (len(a.w), len(b.w)) OR 8 * len(list_intersect(a.w, b.w)) >= len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def A6_similar_neighbours(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", description_tokens(F.col("text")).alias("w"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("x")), t.select(F.col("item_id").alias("b"), F.col("w").alias("y"))
    met = a.join(b, F.col("b") == F.col("a") + 1)
    loose = 8 * F.size(F.array_intersect("x", "y")) >= F.size(F.array_union("x", "y"))
    return met.where((similar_tokens(F.col("x"), F.col("y")) | loose) & (F.size("x") > 0) & (F.size("y") > 0)).select("a", "b")


@query("""WITH t AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' 0123 ab' WHEN 1 THEN string_split(p_name, ' ')[1] || ' and others' WHEN 2 THEN string_split(p_name, ' ')[1] WHEN 3 THEN p_name || ' of another kind altogether, new' ELSE '12 ab' END AS b FROM part),
    w AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9]+'), lambda w: len(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$'))) AS x, list_distinct(list_filter(regexp_extract_all(lower(b), '[a-z0-9]+'), lambda w: len(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$'))) AS y FROM t)
    SELECT p_partkey, len(x) > 0 AND len(y) > 0 AND (len(list_intersect(x, y)) IN (len(x), len(y)) OR 2 * len(list_intersect(x, y)) >= len(x) + len(y) - len(list_intersect(x, y))) AS alike FROM w""")
def A6_similar_names(spark, sf_dir):
    """Names of parts and how they might be printed elsewhere: the same, in part, with more words, without any."""
    first, k = F.element_at(F.split("p_name", " "), 1), F.col("p_partkey") % 5
    printed = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" 0123 ab"))).when(k == 1, F.concat(first, F.lit(" and others"))).when(k == 2, first).when(k == 3, F.concat("p_name", F.lit(" of another kind altogether, new"))).otherwise("12 ab")
    return table(spark, sf_dir, "part").select("p_partkey", similar_tokens(description_tokens(F.col("p_name")), description_tokens(printed)).alias("alike"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS copies FROM documents")
def F6_description_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(normal_description(F.col("text")), 256).alias("key"))
    return docs.join(docs.groupBy("key").agg(F.count("*").alias("copies")), "key").select("doc_id", "copies")


@query("SELECT k, min(pos) AS pos FROM (SELECT o_custkey AS k, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT user_id, 1000000 + event_id FROM events) GROUP BY k")
def U1_ordered_union(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"))
    queued = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") + 1_000_000).alias("pos"))
    return new.unionByName(queued).groupBy("k").agg(F.min("pos").alias("pos"))


@query("""SELECT coalesce(c_custkey, u) AS id, CASE WHEN u IS NULL THEN 'missing' ELSE 'unexpected' END AS what FROM customer FULL JOIN (SELECT DISTINCT user_id + 100 AS u FROM events) ON u = c_custkey WHERE u IS NULL OR c_custkey IS NULL""")
def U2_coverage(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    got = table(spark, sf_dir, "events").select((F.col("user_id") + 100).alias("id")).distinct()
    return known.join(got, "id", "left_anti").withColumn("what", F.lit("missing")).unionByName(got.join(known, "id", "left_anti").withColumn("what", F.lit("unexpected")))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS reasons, count(*) AS n FROM events GROUP BY user_id")
def U7_merged_jobs(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reasons"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def U8_pending(spark, sf_dir):
    applied = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(applied, "id", "left_anti")


@query("""WITH s AS (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS seen, max(event_type) AS last FROM events WHERE event_type <> 'error' GROUP BY 1), n AS (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS seen, max(event_type) AS last FROM events WHERE event_type <> 'click' GROUP BY 1)
    SELECT coalesce(s.k, n.k) AS k, coalesce(s.seen, 0) + coalesce(n.seen, 0) AS seen, coalesce(n.last, s.last) AS last FROM s FULL JOIN n ON s.k = n.k""")
def W3_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counted = lambda when: events.where(when).groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("seen"), F.max("event_type").alias("last"))
    return understanding.upserted(counted("event_type <> 'error'"), counted("event_type <> 'click'"), ["k"], ["seen"])


@query("SELECT c_custkey AS k, c_custkey % 3 + CASE WHEN c_acctbal > 0 AND c_custkey % 4 = c_custkey % 3 THEN 1 ELSE 0 END AS version, CASE WHEN c_acctbal > 0 AND c_custkey % 4 = c_custkey % 3 THEN 'new' ELSE c_mktsegment END AS segment, c_acctbal > 0 AND c_custkey % 4 <> c_custkey % 3 AS conflict FROM customer")
def W5_compare_and_set(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    stored = customer.select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("version"), F.col("c_mktsegment").alias("segment"))
    updates = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 4).alias("expected_version"), F.lit("new").alias("value"))
    return understanding.compare_and_set(stored, updates, "k", "segment")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS statement_id, l_partkey AS transaction_id FROM lineitem), s AS (SELECT s_suppkey AS statement_id, s_nationkey AS created_at FROM supplier)
    SELECT m.transaction_id, o.owner FROM (SELECT DISTINCT transaction_id FROM l WHERE statement_id = 7) m LEFT JOIN (SELECT transaction_id, arg_min(statement_id, (created_at, statement_id)) AS owner FROM l JOIN s USING (statement_id) WHERE statement_id <> 7 GROUP BY 1) o USING (transaction_id)""")
def W4_release_statement(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("statement_id"), F.col("l_partkey").alias("transaction_id")).distinct()
    return understanding.released(links, 7, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("statement_id"), F.col("s_nationkey").alias("created_at")))


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def W2_insert_absent(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return stored.unionByName(new.join(stored, "k", "left_anti"))


@query(with_sql(LEDGER) + "SELECT l.id, l.account_id, coalesce(c.who, l.who) AS who FROM ledger l LEFT JOIN (SELECT account_id, date, amount_pence, max(who) AS who FROM ledger WHERE status = 'confirmed' GROUP BY 1, 2, 3) c USING (account_id, date, amount_pence)")
def W7_carry_restore(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    carry = rows.where("status = 'confirmed'").groupBy("account_id", "date", "amount_pence").agg(F.max("who").alias("carried"))
    return rows.join(carry, ["account_id", "date", "amount_pence"], "left").select("id", "account_id", F.coalesce("carried", "who").alias("who"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def W8_retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-15'").select("event_id", "event_type")


@query(with_sql(MOVEMENT) + """, cover AS (SELECT account_id, min(date) AS a, min(date) + 9 AS b FROM movement GROUP BY 1)
    SELECT id, account_id FROM movement m WHERE text LIKE 'TRANSFER%' AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.account_id = (m.account_id + 1) % 150 AND m.date BETWEEN c.a - 1 AND c.b + 1)""")
def J7_one_sided(spark, sf_dir):
    moves = movements(spark, sf_dir)
    cover = moves.groupBy(F.col("account_id").alias("named")).agg(F.min("date").alias("a"), F.date_add(F.min("date"), 9).alias("b"))
    mine = moves.where("text LIKE 'TRANSFER%'").withColumn("named", (F.col("account_id") + 1) % 150)
    held = (mine["named"] == cover["named"]) & mine["date"].between(F.date_sub(cover["a"], 1), F.date_add(cover["b"], 1))
    return mine.join(cover, held, "left_anti").select("id", "account_id")


@query("""WITH d AS (SELECT o_custkey % 200 AS detected, o_orderkey AS payment, min(o_orderkey) OVER (PARTITION BY o_custkey % 200) AS pos FROM orders), p AS (SELECT o_custkey % 150 AS prior, o_orderkey AS payment FROM orders WHERE o_orderstatus = 'F')
    SELECT detected, prior, count(*) AS overlap FROM d JOIN p USING (payment) GROUP BY 1, 2 HAVING count(*) >= 5""")
def J13_overlap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    d = orders.select((F.col("o_custkey") % 200).alias("detected"), F.col("o_orderkey").alias("payment"))
    p = orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 150).alias("prior"), F.col("o_orderkey").alias("payment"))
    return d.join(p, "payment").groupBy("detected", "prior").agg(F.count("*").alias("overlap")).where("overlap >= 5")


@query(with_sql(CATEGORY) + "SELECT id, list_reduce(list_concat([''], string_split(id, '.')), lambda a, b: a || '/' || b) AS path FROM category")
def J15_ancestors(spark, sf_dir):
    return categories(spark, sf_dir).select("id", F.concat(F.lit("/"), F.array_join(F.split("id", r"\."), "/")).alias("path"))


@query("""WITH c AS (SELECT p_partkey, p_type || '-' || p_size AS model FROM part), k AS (SELECT DISTINCT p_type AS prefix FROM part UNION ALL SELECT DISTINCT p_type || '-1' FROM part)
    SELECT p_partkey, arg_max(prefix, len(prefix)) AS prefix FROM c JOIN k ON starts_with(model, prefix) GROUP BY 1""")
def J19_longest_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(p_type, '-', p_size)").alias("model"), "p_type")
    known = part.select(F.col("p_type").alias("prefix")).distinct()
    known = known.unionByName(known.select(F.concat("prefix", F.lit("-1")).alias("prefix")))
    longest = matching.longest_prefixes(part.select("model"), known, "model", "prefix")
    return part.join(longest, "model").groupBy("p_partkey").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
