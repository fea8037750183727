"""Small operators of accounts, people, banks and profiles: who, which bank, which kind, how complete, what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCOUNT_SIDES = {"current": "bank", "savings": "bank", "credit_card": "card"}
# The days between which a car loan through a broker may bring redress.
REDRESS = ("2007-04-06", "2024-11-01")
#: Confidence from which an inferred decision stands without a second look.
SURE = 0.8


def role_labels(people: DataFrame, key: str) -> DataFrame:
    """people (key, pos, name, role) with label: Adult A, B ..., Child 1 ..., Dependant 1 ... by role, in order.

    Of names that differ in case or space only the first counts; empty names have no label.
    """
    by = Window.partitionBy(key)
    named = people.withColumn("name", F.trim("name")).where("name <> ''").withColumn("norm", F.lower(F.regexp_replace("name", r"\s+", " ")))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy(key, "norm").orderBy("pos"))).where("n = 1")
    group = F.when(F.col("role").isin("adult", "child"), F.col("role")).otherwise("dependant")
    n = F.row_number().over(Window.partitionBy(key, "group").orderBy("pos"))
    numbered = first.withColumn("group", group).withColumn("k", n)
    letter = F.chr(F.lit(65) + (F.col("k") - 1) % 26)
    return numbered.select(key, "name", "role", F.when(F.col("group") == "adult", F.concat(F.lit("Adult "), letter)).otherwise(F.concat(F.initcap("group"), F.lit(" "), F.col("k").cast("string"))).alias("label"))


def default_who(owners: Column) -> Column:
    """The only owner, else the household."""
    return F.when(F.size(owners) == 1, owners[0]).otherwise("household")


def status_for(confidence: Column) -> Column:
    return F.when(confidence >= SURE, "inferred").otherwise("low_confidence")


def kind_of_category(rows: DataFrame, kinds: DataFrame, category: str = "category_id") -> DataFrame:
    """rows with kind: that of the longest prefix of their category which kinds (prefix, kind) has, or null.

    Distinct categories meet the prefixes, then rows meet their category's kind.
    """
    parts = F.split(category, r"\.")
    own = rows.select(category).where(F.col(category).isNotNull()).distinct()
    prefixes = own.select(category, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts")).select(category, "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".").alias("prefix"))
    found = prefixes.join(kinds, "prefix").groupBy(category).agg(F.max_by("kind", "depth").alias("kind"))
    return rows.join(found, category, "left")


def bank_of(statements: DataFrame, sort_codes: DataFrame, bics: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """statements (key, bank_id, bic, text) with provider and told_by: the longest known prefix (six digits, or two) of
    the bank's sort code, else the first eight characters of the BIC, else a name printed in the text.

    markers (needle, rank, provider) are a short list of a bank's legal names and are tried in the order of rank.
    """
    digits = F.regexp_replace(F.coalesce("bank_id", F.lit("")), r"\D", "")
    own = statements.withColumn("digits", F.when(F.length(digits) >= 6, digits))
    codes = lambda n, name: sort_codes.where(F.length("prefix") == n).select(F.col("prefix").alias(f"p{n}"), F.col("provider").alias(name))
    own = own.withColumn("p6", F.substring("digits", 1, 6)).withColumn("p2", F.substring("digits", 1, 2)).withColumn("bic8", F.upper(F.substring("bic", 1, 8)))
    joined = own.join(codes(6, "by_six"), "p6", "left").join(codes(2, "by_two"), "p2", "left").join(bics.select(F.col("bic").alias("bic8"), F.col("provider").alias("by_bic")), "bic8", "left")
    named = markers.agg(F.array_sort(F.collect_list(F.struct("rank", "needle", "provider"))).alias("markers"))
    text = F.lower(F.coalesce("text", F.lit("")))
    shown = F.try_element_at(F.filter("markers", lambda m: F.contains(text, F.lower(m["needle"]))), F.lit(1))["provider"]
    told = joined.join(F.broadcast(named)).withColumn("by_text", shown)  # one row: the list of names
    by_code = F.coalesce("by_six", "by_two")
    return told.select(key, F.coalesce(by_code, "by_bic", "by_text").alias("provider"), F.when(by_code.isNotNull(), "sort code").when(F.col("by_bic").isNotNull(), "bic").when(F.col("by_text").isNotNull(), "text").alias("told_by"))


def kind_doubt(said: Column, chosen: Column) -> Column:
    """Whether a statement says that it is of the other side (card or bank) than the account chosen; unknown says nothing."""
    side = lambda kind: F.element_at(F.create_map(*[F.lit(x) for pair in ACCOUNT_SIDES.items() for x in pair]), kind)
    return F.coalesce(said.isNotNull() & (side(said) != side(chosen)), F.lit(False))


def sign_doubt(one_amount: Column, kind: Column, perspective: Column, has_direction: Column, agree: Column, disagree: Column, new: Column) -> Column:
    """Why a layout's signs can't be trusted yet, or null: "account" (a card's view on a bank account), "rows" (payments to
    the card or refunds read as money out, or purchases as money in) or "no evidence" (a new layout that shows neither)."""
    bank = kind.isin("current", "savings")
    return (
        F.when(~one_amount, None)
        .when(bank, F.when(perspective == "card", "account"))
        .when(has_direction, None)
        .when(disagree > 0, "rows")
        .when((agree == 0) & new, "no evidence")
    )


def redress(kind: Column, via_broker: Column, start: Column) -> Column:
    return (kind == "car finance") & via_broker & start.between(F.lit(REDRESS[0]).cast("date"), F.lit(REDRESS[1]).cast("date"))


def completeness(checks: DataFrame, key: str) -> DataFrame:
    """Of checks (key, check, met): the percentage met, halves to even, and the unmet ones in order of name."""
    unmet = F.array_sort(F.collect_list(F.when(~F.col("met"), F.col("check"))))
    return checks.groupBy(key).agg(F.bround(100 * F.count_if("met") / F.count("*")).cast("bigint").alias("percent"), unmet.alias("unmet"))


def merged_periods(periods: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """keys, from and to: periods (keys, start, end) widened by slack days, those that overlap put together."""
    by = Window.partitionBy(*keys).orderBy("from", "to")
    wide = periods.select(*keys, F.date_sub("start", slack).alias("from"), F.date_add("end", slack).alias("to")).where("from <= to")
    starts = F.coalesce(F.col("from") > F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = wide.withColumn("starts", starts).withColumn("run", F.sum(F.col("starts").cast("int")).over(by))
    return runs.groupBy(*keys, "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def covered(rows: DataFrame, periods: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """rows whose date lies in some period (keys, start, end) or within slack days of it.

    Overlapping periods are put together first, so a row meets one period at most; the join is on keys.
    """
    merged = merged_periods(periods, keys, slack)
    spans = merged.groupBy(*keys).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return rows.join(spans, keys).where(F.exists("spans", lambda s: F.col("date").between(s["from"], s["to"]))).drop("spans")


def district(raw: Column) -> Column:
    """The district of a postcode in capitals without spaces, or null if it isn't one."""
    own = F.upper(F.regexp_replace(F.trim(raw), r"\s+", ""))
    return F.when(own.rlike(r"^[A-Z]{1,2}[0-9][A-Z0-9]?$"), own)


def why(rows: DataFrame, rules: DataFrame, merchants: DataFrame, categories: DataFrame, accounts: DataFrame) -> DataFrame:
    """id and why: the steps that led to a row's category, from its rule, merchant, confidence and partner.

    rows: id, category_id, decided_by, rule_id, merchant_id, confidence, partner_id, ignored. rules: rule_id, description,
    source. merchants: merchant_id, name, usual_category, seen. accounts: partner_id, nickname, partner_date. All are left
    equi-joins; a partner, rule or merchant that is gone leaves its step out. Rows without a key are dealt out by their id,
    so they don't meet in one task; partners may be as many as rows, so they are joined by a shuffle.
    """
    usual = categories.select(F.col("id").alias("usual_category"), F.col("label").alias("usual_label"))
    named = merchants.select("merchant_id", "name", "usual_category", "seen").join(usual, "usual_category", "left")
    joined = rows
    for key, other in (("rule_id", rules.select("rule_id", "description", "source")), ("merchant_id", named), ("partner_id", accounts.select("partner_id", "nickname", "partner_date").hint("merge"))):
        dealt = F.when(F.col(key).isNull(), F.xxhash64("id")).otherwise(F.xxhash64(key))  # a constant would be folded away
        joined = joined.withColumn("__dealt", dealt).join(other.withColumn("__dealt", F.xxhash64(F.col(key).cast(rows.schema[key].dataType))), [key, "__dealt"], "left").drop("__dealt")
    by_rule = F.concat(F.when(F.col("source") == "seed", "Matched the built-in rule ").otherwise("Matched your rule "), "description", F.lit("."))
    by_memory = F.concat(F.lit("Seen "), "name", F.lit(" "), F.col("seen").cast("string"), F.lit(" times"), F.coalesce(F.concat(F.lit(", usually "), "usual_label"), F.lit("")), F.lit("."))
    by_model = F.concat(F.lit("A guess, "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% sure."))
    partner = F.concat(F.lit("Matched with "), "nickname", F.lit(" on "), F.date_format("partner_date", "dd/MM/yyyy"), F.lit("."))
    steps = F.array(F.when(F.col("decided_by") == "human", "You decided it."), F.when(F.col("decided_by") == "rule", by_rule), F.when(F.col("decided_by") == "memory", by_memory), F.when(F.col("decided_by") == "model", by_model), partner, F.when(F.col("ignored"), "It is left out."))
    return joined.select("id", F.array_join(F.array_compact(steps), " ").alias("why"))


def run_summary(counts: DataFrame, key: str) -> DataFrame:
    """key and summary: what a run changed, from its counts by_rule, by_memory, by_model, second_looks, pairs, found, rises, waiting."""
    many = lambda n, one, more: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more))
    c = {name: F.coalesce(name, F.lit(0)) for name in ("by_rule", "by_memory", "by_model", "second_looks", "pairs", "found", "rises", "waiting")}
    told = c["by_rule"] + c["by_memory"] + c["by_model"]
    ways = F.array_join(F.array_compact(F.array(*[F.when(c[k] > 0, F.concat(c[k].cast("string"), F.lit(t))) for k, t in (("by_rule", " by your rules"), ("by_memory", " from memory"), ("by_model", " by the model"))])), ", ")
    line = lambda n, text: F.when(n > 0, text)
    parts = F.array(
        line(told, F.concat(F.lit("Sorted "), many(told, "transaction", "transactions"), F.lit(" ("), ways, F.lit(")."))),
        line(c["second_looks"], F.concat(F.lit("Took a second look at "), many(c["second_looks"], "transaction", "transactions"), F.lit("."))),
        line(c["pairs"], F.concat(F.lit("Matched "), many(c["pairs"], "transfer", "transfers"), F.lit("."))),
        line(c["found"], F.concat(F.lit("Found "), many(c["found"], "regular payment", "regular payments"), F.lit("."))),
        line(c["rises"], F.concat(F.lit("Spotted "), many(c["rises"], "price rise", "price rises"), F.lit("."))),
        line(c["waiting"], F.concat(many(c["waiting"], "transaction", "transactions"), F.lit(" will be tried again next run."))),
    )
    summary = F.array_join(F.array_compact(parts), " ")
    return counts.select(key, F.when(summary == "", "Nothing new to sort.").otherwise(summary).alias("summary"))


def remembered(merchants: DataFrame, guesses: DataFrame, rows: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Merchants after their memory was inferred, and the rows that the new knowledge doesn't make stale.

    merchants: merchant_id, usual_category, memory, confidence, seen. guesses: merchant_id, category_id, confidence, seen.
    A confirmed memory stays; one that says the same is no change. Rows of changed merchants that agree already and aren't
    confirmed take the new version; all others keep theirs.
    """
    new = guesses.select("merchant_id", F.col("category_id").alias("guess"), F.col("confidence").alias("sure"), F.col("seen").alias("now_seen"))
    joined = merchants.join(new, "merchant_id", "left")
    open_ = F.col("guess").isNotNull() & (F.coalesce("memory", F.lit("")) != "confirmed")
    changes = F.coalesce(open_ & ~F.col("guess").eqNullSafe(F.col("usual_category")), F.lit(False))
    after = joined.select(
        "merchant_id", F.when(open_, F.col("guess")).otherwise(F.col("usual_category")).alias("usual_category"), F.when(open_, "inferred").otherwise(F.col("memory")).alias("memory"),
        F.when(open_, F.col("sure")).otherwise(F.col("confidence")).alias("confidence"), F.when(open_, F.col("now_seen")).otherwise(F.col("seen")).alias("seen"), changes.alias("changed"),
    )
    learned = after.where("changed").select("merchant_id", F.col("usual_category").alias("category_id"))
    agree = rows.where("status <> 'confirmed'").join(learned, ["merchant_id", "category_id"]).select("id", F.lit(version).alias("knowledge_version"))
    return after, agree


def commitment_scores(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict (ok, wrong, missing or extra) and what differs, of expected commitments and those found.

    Both: keys, cadence, amount_pence, status, flags. A commitment is right if cadence, amount and status are and it has
    all the flags expected; flags beyond them don't count.
    """
    e = expected.select(*keys, *[F.col(c).alias(f"e_{c}") for c in ("cadence", "amount_pence", "status", "flags")], F.lit(True).alias("expected"))
    f = found.select(*keys, "cadence", "amount_pence", "status", "flags", F.lit(True).alias("found"))
    both = e.join(f, keys, "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"e_{c}")), c) for c in ("cadence", "amount_pence", "status")], F.when(F.size(F.array_except("e_flags", "flags")) > 0, "flags")))
    there = F.col("expected").isNotNull() & F.col("found").isNotNull()
    verdict = F.when(F.col("expected").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.size(wrong) == 0, "ok").otherwise("wrong")
    return both.select(*keys, verdict.alias("verdict"), F.array_join(F.when(there, wrong).otherwise(F.array().cast("array<string>")), ",").alias("differs"))


def upload_counts(plan: DataFrame, key: str) -> DataFrame:
    """Per key of a plan (key, match): rows read, inserted, already there, similar, skipped."""
    n = lambda *kinds: F.count_if(F.col("match").isin(*kinds))
    return plan.groupBy(key).agg(F.count_if(F.col("match") != "skipped").alias("rows"), n("new").alias("inserted"), n("exact").alias("exact"), n("similar").alias("similar"), n("skipped").alias("skipped"))


def errors_by_line(errors: DataFrame, lines: DataFrame, key: str, error: str = "error") -> DataFrame:
    """key, ref, n and first of check errors: those that start with the ref of a line of theirs, others under general."""
    ref = F.regexp_extract(error, r"^([A-Za-z]+\d+):", 1)
    known = lines.select(key, F.col("ref").alias("line_ref")).distinct()
    own = errors.withColumn("line_ref", F.when(ref != "", ref)).join(known.withColumn("known", F.lit(True)), [key, "line_ref"], "left")
    return own.groupBy(key, F.when(F.col("known"), F.col("line_ref")).otherwise("general").alias("ref")).agg(F.count("*").alias("n"), F.min(error).alias("first"))


def merged_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Per key of chunks (key, chunk, n, period_start, period_end, opening_pence, closing_pence): rows in all, the whole
    period, the first opening balance that a chunk has and the last closing one."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("chunk"))
    return chunks.groupBy(key).agg(
        F.sum("n").alias("n"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"),
        F.min_by("opening_pence", at("opening_pence")).alias("opening_pence"), F.max_by("closing_pence", at("closing_pence")).alias("closing_pence"),
    )


def line_aliases(lines: DataFrame, key: str, pos: str, ref: str) -> DataFrame:
    """lines with alias D1, D2 ... in order, which say nothing of the lines between that are held back."""
    return lines.withColumn("alias", F.concat(F.lit("D"), F.row_number().over(Window.partitionBy(key).orderBy(pos, ref)).cast("string")))


def unaliased(replies: DataFrame, aliased: DataFrame, key: str, ref: str) -> DataFrame:
    """replies (key, alias ...) with the ref that an alias stands for; an alias that wasn't given out has none."""
    return replies.join(aliased.select(key, "alias", ref), [key, "alias"], "left")

