"""Whole runs over the driver tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import tokens_estimate
from ..operators import composites, layout, matching, temporal, understanding
from .adapter import LEDGER, MOVEMENT, ledger, movements, table, with_sql
from .registry import query
from .scheduling import _HOLIDAY, holidays
from .understanding import _BEST, _LINES, _PRINTED, _RULE, _VERSIONS, DEDUPED, PAIRED, lines, rule_table, versions

_MEMORY = "mem AS (SELECT s_suppkey AS merchant_id, 'asia.nation-2.building' AS memory_category, CASE WHEN s_suppkey % 3 = 0 THEN 'confirmed' ELSE 'inferred' END AS memory, (s_suppkey % 10) / 10.0 AS memory_confidence, s_suppkey % 8 AS seen FROM supplier WHERE s_acctbal > 0)"


def _memory(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(k.alias("merchant_id"), F.lit("asia.nation-2.building").alias("memory_category"), F.when(k % 3 == 0, "confirmed").otherwise("inferred").alias("memory"), ((k % 10) / 10.0).alias("memory_confidence"), (k % 8).alias("seen"))


@query(with_sql(LEDGER, _RULE, _BEST.replace("FROM ledger t JOIN rule r ON", "FROM (SELECT * FROM ledger WHERE status <> 'confirmed') t JOIN rule r ON"), _MEMORY, _VERSIONS, "stale AS (SELECT id FROM ledger l WHERE EXISTS (SELECT 1 FROM v WHERE v.version > l.knowledge_version AND (v.merchant_id = l.merchant_id OR v.category_id = l.category_id)))",
    """j AS (SELECT l.id, l.status, l.authority, l.decided_by, b.rule_id, b.set_category_id AS rc, m.*, coalesce(memory = 'confirmed' OR (memory = 'inferred' AND seen >= 3 AND memory_confidence >= 0.8), false) AS usable, l.id IN (SELECT id FROM stale) AS st
        FROM ledger l LEFT JOIN best b USING (id) LEFT JOIN mem m ON l.merchant_id = m.merchant_id)""",
    """k AS (SELECT *, CASE WHEN status = 'confirmed' THEN 'confirmed' WHEN rule_id IS NOT NULL THEN CASE WHEN 80 >= authority THEN 'rule' ELSE 'kept' END WHEN usable THEN CASE WHEN CASE memory WHEN 'confirmed' THEN 70 ELSE 60 END >= authority THEN 'memory' ELSE 'kept' END
        WHEN authority > 40 THEN 'kept' WHEN status = 'unknown' OR (decided_by = 'model' AND st) THEN 'pending' WHEN decided_by = 'model' AND status = 'low_confidence' THEN 'second look' ELSE 'kept' END AS step FROM j)""") + "SELECT id, step, CASE step WHEN 'rule' THEN rc WHEN 'memory' THEN memory_category END AS set_category_id FROM k")  # fmt: skip
def D2_code_step(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return composites.code_step(rows, rule_table(spark), _memory(spark, sf_dir), understanding.stale(rows, versions(spark, sf_dir)))


_SIDED = """half AS (SELECT out_id AS id, in_id AS partner, confidence FROM pair UNION ALL SELECT in_id, out_id, confidence FROM pair),
    span AS (SELECT account_id, min(date) - 1 AS first_day, min(date) + 10 AS last_day FROM movement GROUP BY 1),
    word AS (SELECT DISTINCT f.id, f.account_id, f.date, unnest(regexp_extract_all(upper(f.text), '[A-Z0-9]+')) AS phrase FROM free f WHERE f.id NOT IN (SELECT id FROM half)),
    alone AS (SELECT w.id FROM word w JOIN (SELECT DISTINCT account_id, 'REF' || (account_id % 100) AS phrase FROM movement) n ON n.phrase = w.phrase AND n.account_id <> w.account_id
        JOIN span s ON s.account_id = n.account_id WHERE w.date NOT BETWEEN s.first_day AND s.last_day GROUP BY 1)"""


@query(with_sql(MOVEMENT, "free AS (SELECT * FROM movement WHERE text NOT LIKE 'REFUND%')", PAIRED, _SIDED).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT id, 'pair' AS kind, partner, CAST(confidence AS DOUBLE) AS confidence FROM half UNION ALL SELECT id, 'one-sided', NULL, 0.85 FROM alone")
def D6_transfer_run(spark, sf_dir):
    moves = movements(spark, sf_dir)
    names = moves.select("account_id").distinct().select("account_id", F.concat(F.lit("ref"), (F.col("account_id") % 100).cast("string")).alias("phrase"))
    covered = moves.groupBy("account_id").agg(F.min("date").alias("first_day"), F.date_add(F.min("date"), 9).alias("last_day"))
    return composites.transfer_run(moves, moves.where("text LIKE 'REFUND%'"), names, covered)


@query()
def D8_commitment_run(spark, sf_dir):
    paid = ledger(spark, sf_dir).where("amount_pence < 0").select("merchant_id", "account_id", "id", "date", (-F.col("amount_pence")).alias("pence"))
    return composites.commitment_run(paid, datetime.date(2001, 8, 1), tolerance=0.5).select("merchant_id", "account_id", "cadence", "status", "annual_pence", F.array_join("flags", ",").alias("flags"))


@query(with_sql(LEDGER) + """, s AS (SELECT account_id AS series_id, merchant_id, category_id, CASE WHEN min(id) % 3 = 0 THEN 'lapsed' ELSE 'active' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS k FROM ledger) WHERE k = 1 GROUP BY ALL),
    v AS (SELECT *, CASE WHEN status = 'active' THEN CASE WHEN category_id = 'asia' OR starts_with(category_id, 'asia.') THEN 'asia' WHEN starts_with(category_id, 'europe.france.') THEN 'europe.france' END END AS service FROM s)
    SELECT series_id, service, status = 'active' AND (coalesce(count(*) FILTER (status = 'active') OVER (PARTITION BY service) > 1 AND service IS NOT NULL, false) OR count(*) FILTER (status = 'active') OVER (PARTITION BY merchant_id) > 1) AS duplicate FROM v""")
def D8_duplicates(spark, sf_dir):
    """The first payment of each account as a series: duplicates by service or merchant."""
    by = Window.partitionBy("account_id").orderBy("id")
    first = ledger(spark, sf_dir).withColumn("k", F.row_number().over(by)).where("k = 1")
    found = first.select(F.col("account_id").alias("series_id"), "merchant_id", "category_id", F.when(F.col("id") % 3 == 0, "lapsed").otherwise("active").alias("status"))
    return composites.duplicate_commitments(found, ["asia", "europe.france"]).select("series_id", "service", "duplicate")


_SOURCES = "source AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'england' ELSE 'scotland' END AS division, CASE s_suppkey % 4 WHEN 0 THEN 'monthly_day' WHEN 1 THEN 'fortnightly' WHEN 2 THEN 'last_working_day' ELSE 'last_weekday' END AS kind, DATE '1998-01-02' + CAST(s_suppkey % 11 AS INTEGER) AS anchor, CAST(s_suppkey % 31 AS INTEGER) + 1 AS day, CAST(s_suppkey % 7 AS INTEGER) AS weekday FROM supplier)"
_PAY = """days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '1997-12-01', DATE '1999-01-31', INTERVAL 1 DAY) g(d)),
    working AS (SELECT division, d FROM days, (SELECT DISTINCT division FROM holiday) WHERE isodow(d) < 6 AND (division, d) NOT IN (SELECT division, day FROM holiday)),
    months AS (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS m FROM days),
    raw AS (SELECT source_id, division, kind, m + CAST(least(day, day(last_day(m))) - 1 AS INTEGER) AS d FROM source, months WHERE kind = 'monthly_day'
        UNION ALL SELECT source_id, division, kind, last_day(m) FROM source, months WHERE kind = 'last_working_day'
        UNION ALL SELECT source_id, division, kind, max(d) FROM source, days WHERE kind = 'last_weekday' AND isodow(d) = weekday + 1 GROUP BY source_id, division, kind, date_trunc('month', d)
        UNION ALL SELECT source_id, division, kind, d FROM source, days WHERE kind = 'fortnightly' AND date_diff('day', anchor, d) % 14 = 0),
    moved AS (SELECT source_id, kind, d, (SELECT max(w.d) FROM working w WHERE w.division = r.division AND w.d <= r.d) AS p FROM raw r)"""


@query(with_sql(_HOLIDAY, _SOURCES, _PAY) + "SELECT DISTINCT source_id, CASE WHEN kind IN ('monthly_day', 'last_working_day') THEN p ELSE d END AS pay_day FROM moved WHERE pay_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def D10_income_upcoming(spark, sf_dir):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "monthly_day").when(k % 4 == 1, "fortnightly").when(k % 4 == 2, "last_working_day").otherwise("last_weekday")
    sources = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.when(k % 2 == 0, "england").otherwise("scotland").alias("division"), kind.alias("kind"), F.date_add(F.lit(datetime.date(1998, 1, 2)), (k % 11).cast("int")).alias("anchor"), ((k % 31).cast("int") + 1).alias("day"), (k % 7).cast("int").alias("weekday"), F.lit("previous_working_day").alias("adjust"))
    calendar = D.working_days(spark, "1997-11-01", "1999-02-28", holidays(spark))
    return composites.pay_dates(sources, calendar, datetime.date(1998, 1, 1), datetime.date(1998, 12, 31))


@query(with_sql(LEDGER, _RULE, _BEST.replace("FROM ledger t JOIN rule r ON", "FROM (SELECT * FROM ledger WHERE status <> 'confirmed' AND authority <= 80) t JOIN rule r ON")) + "SELECT l.id, l.category_id, b.set_category_id, b.rule_id FROM ledger l JOIN best b USING (id) WHERE l.category_id IS DISTINCT FROM b.set_category_id")
def D11_apply_rules(spark, sf_dir):
    return composites.rule_applied(ledger(spark, sf_dir), rule_table(spark))


@query(with_sql(_LINES, _PRINTED, DEDUPED.format(new="statement_id % 2 = 0", stored="statement_id % 2 = 1")).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT statement_id, match, count(*) AS n FROM (SELECT statement_id, match FROM plan UNION ALL SELECT statement_id, 'new' FROM older) GROUP BY ALL")
def W1_import_statement(spark, sf_dir):
    own = matching.fingerprinted(lines(spark, sf_dir))
    stored = own.where("statement_id % 2 = 1")
    links = stored.select("statement_id", F.col("id").alias("transaction_id"), F.lit("new").alias("match"))
    _, after, _ = composites.imported(lines(spark, sf_dir).where("statement_id % 2 = 0"), stored, links)
    return after.groupBy("statement_id", "match").agg(F.count("*").alias("n"))


@query(with_sql(MOVEMENT) + """, pay AS (SELECT account_id, date AS start, lead(date) OVER (PARTITION BY account_id ORDER BY date) - 1 AS stop FROM (SELECT DISTINCT account_id, date FROM movement WHERE amount_pence > 20000))
    SELECT m.id, CASE WHEN p.stop IS NOT NULL THEN p.start ELSE CAST(date_trunc('month', m.date) AS DATE) END AS period_start, CASE WHEN p.stop IS NOT NULL THEN p.stop ELSE last_day(m.date) END AS period_end FROM movement m ASOF LEFT JOIN pay p ON m.account_id = p.account_id AND m.date >= p.start""")
def F18_period_or_month(spark, sf_dir):
    moves = movements(spark, sf_dir)
    pay = moves.where("amount_pence > 20000").select("account_id", F.col("date").alias("start")).distinct()
    ended = pay.withColumn("stop", F.date_sub(F.lead("start").over(Window.partitionBy("account_id").orderBy("start")), 1)).withColumn("begun", F.col("start"))
    known = temporal.as_of(moves.select("account_id", "id", "date"), ended, ["account_id"], "date", "start", ["begun", "stop"])
    return known.select("id", composites.cycle_or_month(F.col("date"), F.col("begun"), F.col("stop")).alias("p")).select("id", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query("""WITH a AS (SELECT s_suppkey AS account_id, 'bank' || (s_suppkey % 12) AS provider, CASE WHEN s_suppkey % 3 = 0 THEN 'credit_card' ELSE 'current' END AS kind, lpad(CAST(s_suppkey % 7 AS VARCHAR), 4, '0') AS last4 FROM supplier),
    e AS (SELECT c_custkey AS statement_id, 'bank' || (c_custkey % 14) AS provider, lpad(CAST(c_custkey % 9 AS VARCHAR), 4, '0') AS last4 FROM customer)
    SELECT statement_id, CASE WHEN count(account_id) = 1 THEN max(account_id) END AS account_id, count(account_id) AS n_candidates FROM e LEFT JOIN a USING (provider, last4) GROUP BY statement_id""")
def P18_account_match(spark, sf_dir):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    accounts = table(spark, sf_dir, "supplier").select(k.alias("account_id"), F.concat(F.lit("bank"), (k % 12).cast("string")).alias("provider"), F.when(k % 3 == 0, "credit_card").otherwise("current").alias("kind"), F.lpad((k % 7).cast("string"), 4, "0").alias("last4"), F.lit("active").alias("status"))
    evidence = table(spark, sf_dir, "customer").select(c.alias("statement_id"), F.concat(F.lit("bank"), (c % 14).cast("string")).alias("provider"), F.lit(None).cast("string").alias("kind"), F.lpad((c % 9).cast("string"), 4, "0").alias("last4"), F.lit(None).cast("bigint").alias("remembered"))
    return composites.matched_accounts(evidence, accounts).select("statement_id", "account_id", "n_candidates")


_ROOM, _LINE, _ITEMS = 160, 25, 4


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, CASE WHEN length(text) % 3 > 0 THEN role END AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (SELECT DISTINCT conv_id, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS batch, false AS fits FROM t
        UNION ALL SELECT conv_id, turn, k, CASE WHEN own > {_ROOM} THEN 0 WHEN more THEN used + cost ELSE own END, CASE WHEN own > {_ROOM} THEN [] WHEN NOT more THEN list_filter([line], lambda l: l IS NOT NULL) WHEN line IS NULL THEN seen ELSE list_append(seen, line) END,
            CASE WHEN own > {_ROOM} THEN 0 WHEN more THEN n + 1 ELSE 1 END, CASE WHEN own > {_ROOM} OR more THEN batch ELSE batch + 1 END, own <= {_ROOM}
        FROM (SELECT *, n > 0 AND n < {_ITEMS} AND used + cost <= {_ROOM} AND own <= {_ROOM} AS more FROM (SELECT t.conv_id, t.turn, t.k, t.line, f.used, f.seen, f.n, f.batch, t.tokens + CASE WHEN t.line IS NULL THEN 0 ELSE {_LINE} END AS own,
            t.tokens + CASE WHEN t.line IS NULL OR list_contains(f.seen, t.line) THEN 0 ELSE {_LINE} END AS cost FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)))
    SELECT conv_id, turn, CASE WHEN fits THEN batch END AS batch FROM f WHERE k > 0""")
def F27_batches(spark, sf_dir):
    """Turns in batches of four, within a budget, the line of a role counted once a batch; turns too large for any have none."""
    line = F.when(F.length("text") % 3 > 0, F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("pos"), tokens_estimate(F.col("text")).alias("tokens"), line.alias("line"), F.lit(_LINE).cast("bigint").alias("line_tokens"))
    return layout.batches(rows, "conv_id", _ROOM, room_out=200, out_per_item=50, most=60).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "batch")


_WORST = "greatest(side * side * {first} / ({total} * {total}), {total} * {total} / (side * side * {last}))"


@query(f"""WITH RECURSIVE v AS (SELECT n_regionkey AS parent, n_nationkey AS item, CAST(count(c_custkey) AS DOUBLE) AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
    a AS (SELECT parent, item, value * 10000 / sum(value) OVER (PARTITION BY parent) AS area, row_number() OVER (PARTITION BY parent ORDER BY value DESC, item) AS k, count(*) OVER (PARTITION BY parent) AS n FROM v WHERE value > 0),
    f AS (SELECT DISTINCT parent, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 100.0::DOUBLE AS w, 100.0::DOUBLE AS h, CAST([] AS DOUBLE[]) AS line, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) AS put FROM a
        UNION ALL SELECT parent, k, CASE WHEN stay OR w < h THEN x ELSE x + thick END, CASE WHEN stay OR w >= h THEN y ELSE y + thick END, CASE WHEN stay OR w < h THEN w ELSE w - thick END, CASE WHEN stay OR w >= h THEN h ELSE h - thick END,
            CASE WHEN stay THEN list_append(line, area) ELSE [area] END,
            CASE WHEN stay THEN put ELSE list_concat(put, [CASE WHEN w >= h THEN {{'x': x, 'y': y + coalesce(list_sum(line[1:i - 1]), 0) / thick, 'w': thick, 'h': line[i] / thick}} ELSE {{'x': x + coalesce(list_sum(line[1:i - 1]), 0) / thick, 'y': y, 'w': line[i] / thick, 'h': thick}} END FOR i IN range(1, len(line) + 1)]) END
        FROM (SELECT *, len(line) = 0 OR {_WORST.format(first='line[1]', last='area', total='(total + area)')} <= {_WORST.format(first='line[1]', last='line[-1]', total='total')} AS stay, total / side AS thick
            FROM (SELECT f.parent, a.k, a.area, f.x, f.y, f.w, f.h, f.line, f.put, least(f.w, f.h) AS side, coalesce(list_sum(f.line), 0) AS total FROM f JOIN a ON a.parent = f.parent AND a.k = f.k + 1))),
    e AS (SELECT *, list_sum(line) / least(w, h) AS thick FROM f WHERE (parent, k) IN (SELECT (parent, n) FROM a)),
    g AS (SELECT parent, list_concat(put, [CASE WHEN w >= h THEN {{'x': x, 'y': y + coalesce(list_sum(line[1:i - 1]), 0) / thick, 'w': thick, 'h': line[i] / thick}} ELSE {{'x': x + coalesce(list_sum(line[1:i - 1]), 0) / thick, 'y': y, 'w': line[i] / thick, 'h': thick}} END FOR i IN range(1, len(line) + 1)]) AS put FROM e)
    SELECT parent, item, round(put[k].x, 6) AS x, round(put[k].y, 6) AS y, round(put[k].w, 6) AS w, round(put[k].h, 6) AS h FROM a JOIN g USING (parent)""")
def F37_treemap(spark, sf_dir):
    """Nations by their customers, in a square for each region."""
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("value"))
    rows = table(spark, sf_dir, "nation").join(counted, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("item"), "value")
    return layout.treemap(rows, "parent", "item", "value").select("parent", "item", *[F.round(c, 6).alias(c) for c in "xywh"])
