"""Runs put together from the other operators: code step, transfers, commitments, imports, pay dates, account match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_add
from ..shared import cut
from . import accounts, matching, rules, series, understanding

# What decides a row, by rank.
AUTHORITY = {"human": 100, "rule": 80, "confirmed memory": 70, "inferred memory": 60, "model": 40}


def code_step(rows: DataFrame, rule_table: DataFrame, memory: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """id, step (confirmed, rule, memory, pending, second look or kept) and the category that it sets.

    A rule comes before memory, memory (confirmed, or inferred from enough rows and sure enough) before
    a model. What a model guessed is asked again where knowledge has moved on. memory: merchant_id,
    memory_category, memory (confirmed or inferred), memory_confidence, seen.
    """
    ruled = rules.best_rules(rows.where("status <> 'confirmed'"), rule_table).select("id", "rule_id", F.col("set_category_id").alias("rule_category"))
    joined = rows.join(ruled, "id", "left").join(memory, "merchant_id", "left").join(stale_ids.select("id", F.lit(True).alias("is_stale")), "id", "left")
    usable = (F.col("memory") == "confirmed") | ((F.col("memory") == "inferred") & (F.col("seen") >= understanding.MEMORY_ROWS) & (F.col("memory_confidence") >= understanding.MEMORY_SURE))
    own = F.when(F.col("memory") == "confirmed", AUTHORITY["confirmed memory"]).otherwise(AUTHORITY["inferred memory"])
    may = lambda authority: authority >= F.coalesce("authority", F.lit(0))
    by_rule, by_memory = F.col("rule_id").isNotNull(), F.coalesce(usable, F.lit(False)) & F.col("rule_id").isNull()
    step = (
        F.when(F.col("status") == "confirmed", "confirmed")
        .when(by_rule, F.when(may(F.lit(AUTHORITY["rule"])), "rule").otherwise("kept"))
        .when(by_memory, F.when(may(own), "memory").otherwise("kept"))
        .when(F.col("authority") > AUTHORITY["model"], "kept")
        .when((F.col("status") == "unknown") | ((F.col("decided_by") == "model") & F.coalesce("is_stale", F.lit(False))), "pending")
        .when((F.col("decided_by") == "model") & (F.col("status") == "low_confidence"), "second look")
        .otherwise("kept")
    )
    stepped = joined.withColumn("step", step)
    return stepped.select("id", "step", F.when(F.col("step") == "rule", F.col("rule_category")).when(F.col("step") == "memory", F.col("memory_category")).alias("set_category_id"))


def transfer_run(moves: DataFrame, blocked: DataFrame, names: DataFrame, covered: DataFrame, slack: int = 1) -> DataFrame:
    """Transfer decisions: pairs first, then rows that name an account of which no statement covers their day.

    blocked: ids that a rule or the person has filed. names: account_id, phrase. covered: account_id,
    first_day, last_day. Named accounts meet rows by the words of their texts; as many accounts may share a phrase,
    those without a statement on a row's day are counted by phrase and day, and don't meet rows one by one.
    """
    free = moves.join(blocked.select("id"), "id", "left_anti")
    pairs = matching.pair_transfers(free)
    halves = pairs.select(F.col("out_id").alias("id"), F.col("in_id").alias("partner"), "confidence").unionByName(pairs.select(F.col("in_id").alias("id"), F.col("out_id").alias("partner"), "confidence"))
    words = free.join(halves.select("id"), "id", "left_anti").where("account_id IS NOT NULL AND date IS NOT NULL").select("id", "account_id", "date", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9]+"), F.lit(0)))).alias("phrase"))
    known = names.where("account_id IS NOT NULL AND phrase IS NOT NULL").select("account_id", F.upper("phrase").alias("phrase")).distinct()
    named = cut(words.join(known.select("phrase").distinct(), "phrase", "left_semi"))
    spans = accounts.merged_periods(covered.select("account_id", F.col("first_day").alias("start"), F.col("last_day").alias("end")), ["account_id"], slack)
    # how many of a phrase's accounts a statement covers on a day: a running sum over days on which that changes
    change = lambda day, by: known.join(spans, "account_id").select("phrase", day.alias("date"), F.lit(by).alias("by"))
    changes = change(F.col("from"), 1).unionByName(change(F.date_add("to", 1), -1)).groupBy("phrase", "date").agg(F.sum("by").alias("by"))
    asked = named.select("phrase", "date").distinct().withColumn("by", F.lit(0).cast("bigint"))
    days = changes.unionByName(asked).groupBy("phrase", "date").agg(F.sum("by").alias("by"))
    held = days.withColumn("held", F.sum("by").over(Window.partitionBy("phrase").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).drop("by")
    open_ = cut(held.join(known.groupBy("phrase").agg(F.count("*").alias("n")), "phrase").select("phrase", "date", (F.col("n") - F.col("held")).alias("open")).where("open > 0"))
    # a row's own account doesn't count
    own = known.join(spans.groupBy("account_id").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "account_id", "left").withColumn("own", F.lit(1))
    mine = named.join(open_, ["phrase", "date"]).join(own, ["phrase", "account_id"], "left")
    is_held = F.coalesce(F.exists("spans", lambda s: F.col("date").between(s["from"], s["to"])), F.lit(False))
    alone = mine.where(F.col("open") > F.when(is_held, 0).otherwise(F.coalesce("own", F.lit(0)))).select("id").distinct()
    return halves.select("id", F.lit("pair").alias("kind"), "partner", "confidence").unionByName(alone.select("id", F.lit("one-sided").alias("kind"), F.lit(None).cast(halves.schema["partner"].dataType).alias("partner"), F.lit(0.85).alias("confidence")))


def commitment_run(payments: DataFrame, until, dismissed: DataFrame | None = None, tolerance: float = 0.15) -> DataFrame:
    """Detected series with flags: price rise within a year, trial, lapsed, and duplicate (several active of one merchant).

    Series are written and counted by merchant, and meet the counts: a merchant of very many accounts isn't one task's.
    """
    found = series.detect(payments, until, tolerance)
    if dismissed is not None:
        found = found.join(dismissed.select("merchant_id", "account_id"), ["merchant_id", "account_id"], "left_anti")
    last, before = F.try_element_at("price_history", F.lit(-1)), F.try_element_at("price_history", F.lit(-2))
    rise = (last["amount_pence"] > before["amount_pence"]) & (F.datediff(F.lit(until) if not isinstance(until, DataFrame) else F.col("last_date"), last["since"]) <= 365)
    found = cut(found)
    twins = cut(found.where("status = 'active'").groupBy("merchant_id").agg(F.count("*").alias("twins")))
    flags = F.array_compact(F.array(F.when(F.coalesce(rise, F.lit(False)), "price rise"), F.when(F.col("trial_id").isNotNull(), "trial"), F.when(F.col("status") == "lapsed", "lapsed"), F.when((F.col("status") == "active") & (F.col("twins") > 1), "duplicate")))
    return found.join(twins, "merchant_id", "left").select(*found.columns, flags.alias("flags"))


def duplicate_commitments(found: DataFrame, services: list[str]) -> DataFrame:
    """found (status, merchant_id, category_id and others) with service and duplicate: active series of one merchant, or of one kind of
    service, whichever merchants. services: parent categories; the first that a category is or lies under is its service.

    Counts by service and merchant are small and written first, so a service of very many series can be split.
    """
    service = F.coalesce(*[F.when((F.col("category_id") == p) | F.startswith("category_id", F.lit(f"{p}.")), F.lit(p)) for p in services], F.lit(None).cast("string"))
    own = found.drop("service", "duplicate").withColumn("service", F.when(F.col("status") == "active", service))
    active = own.where("status = 'active'")
    many = lambda by: cut(active.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).where("n > 1").select(by, F.lit(True).alias(f"__{by}")))
    met = own.join(many("service"), "service", "left").join(many("merchant_id"), "merchant_id", "left")
    return met.withColumn("duplicate", (F.col("status") == "active") & F.coalesce("__service", "__merchant_id", F.lit(False))).select(*own.columns, "duplicate")


def imported(statement: DataFrame, stored: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored transactions and links after a statement, and its plan (id, match).

    Running it again with the same statement changes nothing: its own links are dropped first, its rows
    match by fingerprint, and ids are hashes.
    """
    own = matching.fingerprinted(statement)
    plan = matching.dedupe_plan(own, stored)
    new = own.join(plan.where("match = 'new'").select("id"), "id", "left_semi")
    after = stored.unionByName(new.select(*stored.columns))
    rest = links.join(own.select("statement_id").distinct(), "statement_id", "left_anti")
    return after, rest.unionByName(own.join(plan, "id").select("statement_id", F.col("id").alias("transaction_id"), "match")), plan


def pay_dates(sources: DataFrame, calendar: DataFrame, start, end) -> DataFrame:
    """Pay days of income sources from start to end.

    sources: source_id, division, kind (weekly, fortnightly, four_weekly, last_working_day, last_weekday,
    monthly_day), anchor, day, weekday (0 is Monday), adjust. calendar: division, day, previous, next.
    Months on both sides are looked at, as adjusting may move a day over a month's end.
    """
    stride = F.when(F.col("kind") == "weekly", 7).when(F.col("kind") == "fortnightly", 14).otherwise(28)
    ahead = F.pmod(F.datediff(F.col("anchor"), F.lit(start)), stride)
    every = F.transform(F.sequence(F.lit(0), F.floor((F.datediff(F.lit(end), F.lit(start)) - ahead) / stride).cast("int")), lambda k: F.date_add(F.date_add(F.lit(start), ahead), (k * stride).cast("int")))
    months = F.sequence(F.add_months(F.trunc(F.lit(start), "month"), -1), F.add_months(F.trunc(F.lit(end), "month"), 1), F.expr("interval 1 month"))
    on_day = F.transform(months, lambda m: month_add(m, F.lit(0), F.when(F.col("kind") == "monthly_day", F.col("day")).otherwise(0)))
    weekday = F.transform(on_day, lambda d: F.date_sub(d, F.pmod(F.weekday(d) - F.col("weekday"), F.lit(7)).cast("int")))
    interval = F.col("kind").isin("weekly", "fortnightly", "four_weekly")
    wanted = F.when(interval & (F.datediff(F.lit(end), F.lit(start)) >= ahead), every).when(interval, F.array().cast("array<date>")).when(F.col("kind") == "last_weekday", weekday).otherwise(on_day)
    raw = sources.withColumn("raw_day", F.explode(wanted))
    moved = raw.join(calendar.select(F.col("division"), F.col("day").alias("raw_day"), "previous", "next"), ["division", "raw_day"], "left")
    early = (F.col("kind") == "last_working_day") | ((F.col("kind") == "monthly_day") & (F.col("adjust") == "previous_working_day"))
    late = (F.col("kind") == "monthly_day") & (F.col("adjust") == "next_working_day")
    day = F.when(early, F.coalesce("previous", "raw_day")).when(late, F.coalesce("next", "raw_day")).otherwise(F.col("raw_day"))
    return moved.select("source_id", day.alias("pay_day")).where(F.col("pay_day").between(F.lit(start), F.lit(end))).distinct()


def cycle_or_month(day: Column, start: Column, stop: Column) -> Column:
    """The pay cycle that holds day, or its month where the cycle isn't known on both sides."""
    known = start.isNotNull() & stop.isNotNull()
    return F.struct(F.when(known, start).otherwise(F.trunc(day, "month")).alias("start"), F.when(known, stop).otherwise(F.last_day(day)).alias("end"))


def matched_accounts(evidence: DataFrame, accounts: DataFrame) -> DataFrame:
    """statement_id, account_id (a sure match, or null), best_guess, n_candidates.

    evidence: statement_id, provider, kind, last4, remembered (account). A bank narrows the accounts, so
    does a firm kind; the last four digits or being the only one at its bank make a match sure; an
    earlier answer decides where no account of the same bank and kind stands beside it.

    Statements meet counts of accounts by bank, kind and digits, not accounts, so that a bank with many of both makes no pairs.
    """
    a = accounts.where("status = 'active' AND provider IS NOT NULL").select("account_id", F.col("provider").alias("a_provider"), F.col("kind").alias("a_kind"), F.col("last4").alias("a_last4"))
    # an account is counted among its bank's and among those of its kind there; by its digits, all in all, and without digits
    said = lambda c: F.concat(F.lit("="), c)
    sides = F.explode(F.array_compact(F.array(F.lit("any"), said(F.col("a_kind"))))).alias("side")
    ends = F.explode(F.array(F.lit("any"), F.coalesce(said(F.col("a_last4")), F.lit("none")))).alias("ends")
    pools = cut(a.select("account_id", F.col("a_provider").alias("provider"), "a_last4", sides).select("account_id", "provider", "side", ends).groupBy("provider", "side", "ends").agg(F.count("*").alias("n"), F.max("account_id").alias("one")))
    told = F.col("last4").isNotNull()
    own = evidence.select("statement_id", "provider", "kind", "last4", "remembered").withColumn("side", F.coalesce(said(F.col("kind")), F.lit("any"))).withColumn("ends", F.coalesce(said(F.col("last4")), F.lit("any")))
    without = pools.where("ends = 'none'").select("provider", "side", F.col("n").alias("n_without"), F.col("one").alias("one_without"))
    met = own.join(pools, ["provider", "side", "ends"], "left").join(without, ["provider", "side"], "left")
    unmatched = told & F.col("n").isNull()
    n, one = F.coalesce("n", F.when(told, F.col("n_without"))), F.coalesce("one", F.when(told, F.col("one_without")))
    best = met.select("statement_id", F.when(n == 1, one).alias("only"), unmatched.alias("unmatched"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n_candidates"))
    # an account remembered is a candidate if it's of the bank and kind and among those that the digits leave
    siblings = a.groupBy("a_provider", "a_kind").agg(F.count("*").alias("siblings"))
    known = evidence.where("remembered IS NOT NULL").join(a, (F.col("remembered") == F.col("account_id")) & (F.col("provider") == F.col("a_provider")) & (F.col("kind").isNull() | (F.col("kind") == F.col("a_kind")))).drop("account_id")
    alone = siblings.select(F.col("a_provider").alias("s_provider"), F.col("a_kind").alias("s_kind"), "siblings")
    known = known.join(alone, (F.col("a_provider") == F.col("s_provider")) & F.col("a_kind").eqNullSafe(F.col("s_kind")))
    same = F.coalesce(F.col("last4") == F.col("a_last4"), F.lit(False))
    known = known.select("statement_id", F.col("remembered").alias("kept"), same.alias("same"), F.col("a_last4").isNull().alias("bare"), ((F.col("siblings") == 1) & same).alias("sure"), told.alias("told"))
    both = best.join(known, "statement_id", "left")
    candidate = F.when(F.coalesce(~F.col("told") | F.col("same") | (F.col("bare") & F.col("unmatched")), F.lit(False)), F.col("kept"))
    return both.select("statement_id", F.coalesce(F.when(~F.col("unmatched"), F.col("only")), F.when(F.col("sure"), F.col("kept"))).alias("account_id"), F.coalesce("only", candidate).alias("best_guess"), "n_candidates")


def rule_applied(rows: DataFrame, rule_table: DataFrame) -> DataFrame:
    """What applying rules to the past writes: the rows that change, with their new category."""
    best = rules.best_rules(rows.where("status <> 'confirmed' AND authority <= 80"), rule_table)
    return rows.join(best, "id").where(~F.col("category_id").eqNullSafe(F.col("set_category_id"))).select("id", "category_id", "set_category_id", "rule_id")
