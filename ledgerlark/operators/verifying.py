"""Checks of read statements: signs, evidence, coverage; and sign repair from printed balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import evidence, household_sign_wrong
from .temporal import running_mismatches

#: Unsigned rows of a stretch from which on ways aren't counted.
MOST_UNSIGNED = 16


def stretches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with stretch (rows up to and with each printed balance), and the printed balance before it."""
    by = Window.partitionBy(*keys).orderBy("pos")
    numbered = rows.withColumn("stretch", F.coalesce(F.sum(F.col("balance_after_pence").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.withColumn("before_pence", F.last("balance_after_pence", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))


def ways(rows: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Per stretch with known balances on both sides: unsigned rows, and in how many ways (0, 1 or 2 for
    more) their signs make it add up. Sums are folded into a map of reachable totals, at most 2 ^ 16.

    Column unsigned tells rows without a printed sign.
    """
    grouped = stretches(rows, keys).groupBy(*keys, "stretch").agg(
        F.first("before_pence").alias("before"), F.max("balance_after_pence").alias("after"),
        F.sum(F.when(F.col("unsigned"), 0).otherwise(F.col("amount_pence"))).alias("fixed"), F.collect_list(F.when(F.col("unsigned"), F.abs("amount_pence"))).alias("sizes"),
    ).where("before IS NOT NULL AND after IS NOT NULL AND size(sizes) > 0")
    start = F.array(F.lit(0).cast("bigint"))
    reached = F.aggregate(F.when(F.size("sizes") <= MOST_UNSIGNED, F.col("sizes")).otherwise(F.array().cast("array<bigint>")), start, lambda sums, x: F.concat(F.transform(sums, lambda s: s + x), F.transform(sums, lambda s: s - x)))
    gap = F.col("after") - F.col("before") - F.col("fixed")
    found = F.size(F.filter(reached, lambda s: F.abs(s - gap) <= tolerance))
    return grouped.select(*keys, "stretch", F.size("sizes").alias("n_unsigned"), F.when(F.size("sizes") <= MOST_UNSIGNED, F.least(found, F.lit(2))).alias("ways"))


def repaired_signs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in which a lone unsigned amount of a stretch takes the sign that its balances prove."""
    own = stretches(rows, keys)
    by = Window.partitionBy(*keys, "stretch")
    whole = F.sum(F.when(F.col("unsigned"), 0).otherwise(F.col("amount_pence"))).over(by)
    gap = F.max("balance_after_pence").over(by) - F.col("before_pence") - whole
    lone = F.col("unsigned") & (F.sum(F.col("unsigned").cast("int")).over(by) == 1)
    flips = lone & (gap == -F.col("amount_pence"))
    return own.select(*rows.columns, F.coalesce(flips, F.lit(False)).alias("flipped")).withColumn("amount_pence", F.when(F.col("flipped"), -F.col("amount_pence")).otherwise(F.col("amount_pence")))


def verified(rows: DataFrame, statements: DataFrame, key: str, tolerance: int = 1) -> DataFrame:
    """key, ref, code: what is to be looked at in read statements. Signs are repaired first, then rows and statements checked.

    rows: key, ref, pos, text (the line that a row was read from), amount_pence, balance_after_pence, unsigned. statements:
    key, opening_pence, closing_pence, doubt (why the account or its signs can't be trusted, or null). Codes of rows: not
    printed (the amount isn't on its line), sign (the line prints the other one), balance (the printed balance isn't what
    the one before and the rows since lead to); of statements, without a ref: closing, no rows, and their doubt.
    """
    own = repaired_signs(rows, [key])
    on_line = F.array_compact(F.array(F.when(~evidence(F.col("text"), F.col("amount_pence")), "not printed"), F.when(household_sign_wrong(F.col("text"), F.col("amount_pence")), "sign")))
    by_row = own.select(key, "ref", F.explode(on_line).alias("code"))
    running = running_mismatches(own.withColumn("id", F.col("ref")), [key], tolerance).select(key, F.col("id").alias("ref"), F.lit("balance").alias("code"))
    sums = own.groupBy(key).agg(F.sum("amount_pence").alias("total"))
    read = statements.join(sums, key, "left")
    off = F.abs(F.col("opening_pence") + F.col("total") - F.col("closing_pence")) > tolerance
    codes = F.array_compact(F.array(F.when(F.col("total").isNull(), "no rows"), F.when(off, "closing"), F.col("doubt")))
    whole = read.select(key, F.lit(None).cast(rows.schema["ref"].dataType).alias("ref"), F.explode(codes).alias("code"))
    return by_row.unionByName(running).unionByName(whole)


def line_coverage(rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, ref, code: what read rows say of the lines that they were read from.

    rows: key, ref (of a row or a skipped line; what stands after # is a part of its line). lines: key, ref, is_data (or a
    heading, given for context only). Codes: duplicate, header, unexpected; and missing, without a ref, with the refs of
    data lines that no row names, runs of numbered ones in short: L3-L7, L9. Rows without a ref name no line.
    """
    named = rows.where("ref IS NOT NULL AND ref <> ''").groupBy(key, "ref").agg(F.count("*").alias("n")).withColumn("base", F.substring_index("ref", "#", 1))
    known = lines.groupBy(key, F.col("ref").alias("base")).agg(F.bool_and("is_data").alias("is_data"))
    met = named.join(known, [key, "base"], "left")
    codes = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate"), F.when(F.col("is_data").isNull(), "unexpected").when(~F.col("is_data"), "header")))
    odd = met.select(key, "ref", F.explode(codes).alias("code"), F.lit(None).cast("string").alias("refs"))
    missing = known.where("is_data").join(named.select(key, "base").distinct(), [key, "base"], "left_anti").withColumn("number", F.regexp_extract("base", r"^L([0-9]+)$", 1).try_cast("bigint"))
    by = Window.partitionBy(key).orderBy("number")
    numbered = missing.where("number IS NOT NULL")
    runs = numbered.withColumn("run", F.col("number") - F.row_number().over(by)).groupBy(key, "run").agg(F.min("number").alias("at"), F.max("number").alias("to"))
    shown = runs.select(key, "at", F.concat(F.lit("L"), "at", F.when(F.col("to") > F.col("at"), F.concat(F.lit("-L"), "to")).otherwise("")).alias("text"))
    others = missing.where("number IS NULL").select(key, F.lit(None).cast("bigint").alias("at"), F.col("base").alias("text"))
    parts = shown.unionByName(others).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("at", F.lit((1 << 63) - 1)).alias("at"), "text"))).alias("parts"))
    told = parts.select(key, F.lit(None).cast(rows.schema["ref"].dataType).alias("ref"), F.lit("missing").alias("code"), F.array_join(F.transform("parts", lambda p: p["text"]), ", ").alias("refs"))
    return odd.unionByName(told)


#: Days of a statement's period at most, and days that a row may lie outside of it; pence of a row at most.
MOST_PERIOD_DAYS, PERIOD_SLACK, MOST_PENCE = 400, 3, 100_000_000_00


def period_codes(rows: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """key, ref, code: of statements (key, period_start, period_end) no start, no end, reversed or too long; of rows (key, ref, date,
    amount_pence) outside (of a period that is none of these, with some slack), zero and too large."""
    start, end = F.col("period_start"), F.col("period_end")
    days = F.datediff(end, start)
    whole = statements.withColumn("code", F.array_compact(F.array(F.when(start.isNull(), "no start"), F.when(end.isNull(), "no end"), F.when(days < 0, "reversed").when(days > MOST_PERIOD_DAYS, "too long"))))
    fine = whole.where(F.size("code") == 0).select(key, "period_start", "period_end")
    met = rows.join(fine, key, "left")
    inside = F.col("date").between(F.date_sub(start, PERIOD_SLACK), F.date_add(end, PERIOD_SLACK))
    codes = F.array_compact(F.array(F.when(~inside, "outside"), F.when(F.col("amount_pence") == 0, "zero"), F.when(F.abs("amount_pence") > MOST_PENCE, "too large")))
    by_row = met.select(key, "ref", F.explode(codes).alias("code"))
    return by_row.unionByName(whole.select(key, F.lit(None).cast(rows.schema["ref"].dataType).alias("ref"), F.explode("code").alias("code")))


def sign_label(text):
    """Sign told by a label in a line: the first of an ordered list that occurs."""
    labels = ((r"\bdr\b", -1), (r"\bcr\b", 1), (r"\b(paid|money) out\b", -1), (r"\bwithdraw", -1), (r"\b(paid|money) in\b", 1), (r"\bdeposit", 1), (r"\bdebit", -1), (r"\bcredit", 1), (r"\bout\b", -1), (r"\bin\b", 1))
    lower = F.lower(text)
    return F.coalesce(*[F.when(lower.rlike(p), F.lit(s)) for p, s in labels])
